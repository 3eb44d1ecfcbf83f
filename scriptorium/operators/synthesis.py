"""Extractive answers: cleaned paragraphs, definitions and salient sentences of ranked results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T

#: Replies without content.
NO_RESULTS = "No verified document sections matched your query with sufficient relevance."
ONLY_CODE = "Relevant sections were found in your documents, but they contain technical code or listings. Please specify 'code' if you would like to inspect the implementation directly."
#: What sentences are noise.
NOISE_STARTS = ("#", "import ", "try:", "print(", "except", "def ", "return ")
NOISE_STARTS_ANY_CASE = ("page ", "## page ")
NOISE_PARTS = (" = ", "os.path", "uuid.")
NOISE_PARTS_ANY_CASE = ("chapter title page", "table of contents")
OUTLINE_PREFIXES = (r"^\s*\d+(\.\d+)*[:.)-]\s*", r"^\s*\(\s*[a-zA-Z0-9]+\s*\)\s*", r"^\s*[a-zA-Z0-9]+\)\s*")
DINGBATS = "[⮚✓➢❖■➔]+"
BULLETS = ("- ", "• ", "* ")
MOST_STATEMENTS = 4


def paragraphs(text: str | None) -> list[str]:
    """Lines joined to paragraphs; a blank line ends one, a bullet begins one, a final hyphen joins closely."""
    out: list[str] = []
    open_ = False
    for raw in re.split(r"\r?\n", re.sub(DINGBATS, "\n- ", text or "")):
        line = raw.strip(T.TRIMMED)
        if not line:
            open_ = False
        elif line.startswith(BULLETS) or not open_:
            out.append(line)
            open_ = True
        else:
            out[-1] += line if out[-1].endswith("-") else " " + line
    return [p.strip(T.TRIMMED) for p in out]


def salient_sentences(text: str, keywords: list[str], most: int = 3) -> list[str]:
    """The first sentences that hold a keyword and are no noise, closed with a full stop."""
    out = []
    for part in re.split(r"(?<=[.!?\n])\s+", text, flags=re.ASCII):
        s = re.sub(r"\s+", " ", part, flags=re.ASCII).strip(T.TRIMMED)
        low = s.lower()
        if len(s) < 25 or s.startswith(NOISE_STARTS) or low.startswith(NOISE_STARTS_ANY_CASE):
            continue
        if any(x in s for x in NOISE_PARTS) or any(x in low for x in NOISE_PARTS_ANY_CASE):
            continue
        for prefix in OUTLINE_PREFIXES:
            s = re.sub(prefix, "", s, flags=re.ASCII)
        s = s.strip(T.TRIMMED)
        if len(s) >= 20 and any(k in s.lower() for k in keywords):
            out.append(s if s.endswith((".", "!", "?")) else s + ".")
            if len(out) == most:
                break
    return out


def definition(line: str) -> tuple[str, str] | None:
    """(term, definition) of a line of the form `term: definition`, else None."""
    if line.startswith("http") or not (":" in line or " - " in line or " – " in line):
        return None
    first, _, rest = _split_once(line)
    term = re.sub(r"[*#_`~⮚✓➢❖■➔()]+", "", first)
    term = re.sub(r"^\s*\d+(\.\d+)*[:.)-]\s*", "", term, flags=re.ASCII).strip(T.TRIMMED)
    meaning = re.sub(r"^[:–-]\s*", "", rest, flags=re.ASCII).strip(T.TRIMMED)
    sized = len(re.sub("[^a-zA-Z0-9]", "", term)) >= 2 and len(term) <= 50 and len(meaning) >= 12
    return (term, meaning) if sized and "," not in term and len(re.split(r"\s+", term, flags=re.ASCII)) <= 5 else None


def _split_once(line: str) -> tuple[str, str, str]:
    m = re.search("[:–-]", line)
    return (line[: m.start()], m.group(), line[m.end() :]) if m else (line, "", "")


def _python_outline(text: str) -> str:
    for pattern in T.OUTLINE_PATTERNS:
        text = re.sub(pattern, "", text, flags=re.ASCII)
    return text.strip(T.TRIMMED)


def _code(text: str, query: str) -> bool:
    asked = any(w in query.lower() for w in P.ASKS_FOR_CODE)
    return not asked and sum(m in text.lower() for m in P.CODE_MARKS) >= 2


def _cover(text: str) -> bool:
    low = text.lower()
    return (
        not text.strip()
        or (low.startswith("# document:") and len(text) < 280)
        or (any(m in low for m in P.NOTICE_MARKS) and len(text) < 220)
        or any(m in low for m in P.INDEX_MARKS)
    )


def synthesise(query: str | None, texts: list[str], overviews: dict[str, str] | None = None, terms: dict[str, str] | None = None) -> str:
    """An answer from ranked texts: an overview sentence, definitions, further statements.

    overviews: fixed overviews by keyword; terms: fixed definitions by how a line begins. Both are
    tables of the corpus's owner and empty by default.
    """
    if not texts:
        return NO_RESULTS
    query = query or ""
    keywords = [w for w in dict.fromkeys(re.split("[^a-z0-9]+", query.lower())) if len(w) > 2 and w not in T.STOP_WORDS]
    overview = next((o for k, o in (overviews or {}).items() if k in query.lower()), None)
    definitions: dict[str, str] = {}
    statements: list[str] = []
    for text in texts:
        clean = _python_outline(text)
        if not clean or _code(clean, query) or _cover(clean):
            continue
        for line in paragraphs(clean):
            if len(line) < 10:
                continue
            if line.startswith(BULLETS):
                line = line[2:].strip(T.TRIMMED)
            if line.lower() == "chapter" or line.lower().startswith("volume -"):
                continue
            fixed = next(((k, d) for k, d in (terms or {}).items() if line.startswith(k)), None)
            if fixed:
                definitions[fixed[0]] = fixed[1]
                continue
            found = definition(line)
            if found:
                if len(found[1]) > len(definitions.get(found[0], "")):
                    definitions[found[0]] = found[1]
                continue
            for s in salient_sentences(line, keywords):
                if s.lower().startswith("volume -") or s == "CHAPTER" or s.endswith(":") or len(s) < 25:
                    continue
                if overview is None and 40 < len(s) < 280 and "•" not in s:
                    overview = s
                elif s not in statements and s not in definitions:
                    statements.append(s)
    answer = f"{overview}\n\n" if overview else ""
    answer += "".join(f"• **{t}**: {d}\n" for t, d in definitions.items())
    if overview is None and not definitions:
        answer += "".join(f"• {s}\n" for s in statements)
    else:
        for s in statements[:MOST_STATEMENTS]:
            if s not in answer:
                answer += f"• {s}\n"
    if answer.strip():
        return answer.strip(T.TRIMMED)
    for text in texts:
        flat = re.sub(r"(\r?\n)+", " ", _python_outline(text)).strip(T.TRIMMED)
        if flat and not _code(flat, query) and not _cover(flat):
            if len(flat) > 500:
                dot = flat.find(".", 400)
                flat = flat[: dot + 1] if 0 <= dot < 600 else flat[:500] + "…"
            return flat
    return ONLY_CODE


def answers(results: DataFrame, overviews: dict[str, str] | None = None, terms: dict[str, str] | None = None) -> DataFrame:
    """(query_id, answer) from filtered results (query_id, query, rank, text); each query's rows are its top-k."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        answer = synthesise(rows["query"].iloc[0], [t or "" for t in rows["text"]], overviews, terms)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "answer": [answer]})

    kind = dict(results.dtypes)["query_id"]
    return results.select("query_id", "query", "rank", "text").groupBy("query_id").applyInPandas(one, f"query_id {kind}, answer string")


@F.pandas_udf(types.ArrayType(types.StringType()))
def paragraphs_of(texts: pd.Series) -> pd.Series:
    """`paragraphs` in Arrow batches."""
    return texts.map(paragraphs)


def salient(column: Column, query: str) -> Column:
    """`salient_sentences` of each text for a literal query."""
    keywords = [w for w in dict.fromkeys(re.split("[^a-z0-9]+", query.lower())) if len(w) > 2 and w not in T.STOP_WORDS]

    @F.pandas_udf(types.ArrayType(types.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: salient_sentences(t or "", keywords))

    return run(column)


def definitions_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, definition): the definitions of each text, the longest of each term (the earlier of equals)."""

    @F.pandas_udf("array<struct<term:string,definition:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict[str, str]]:
            best: dict[str, str] = {}
            for line in (t or "").split("\n"):
                found = definition(line.strip(T.TRIMMED))
                if found and len(found[1]) > len(best.get(found[0], "")):
                    best[found[0]] = found[1]
            return [{"term": a, "definition": b} for a, b in best.items()]

        return texts.map(one)

    return rows.select(key, F.explode(run(F.col(text))).alias("d")).select(key, "d.term", "d.definition")
