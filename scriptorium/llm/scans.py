"""Problem 7: noise in text from scanned pages.

1. Running lines (page numbers, headers, footers) between the lines of a text are dropped: fixed forms,
   and short lines, numbers masked, that interrupt the sentences of several texts of the document or
   the corpus; words
   broken by a hyphen or a sign standing for it at a line end are joined, except compounds that the
   corpus writes with the hyphen inside lines.
2. The frequencies of all words of the corpus form a lexicon. A symmetric-delete index (all strings
   that arise by deleting up to two characters) joins rare words with frequent ones; a weighted edit
   distance, cheap for shapes that scanners confuse, decides between them, ties by frequency. A text
   counts once, however often it was delivered, or with its copies if only these show the ratio. Words with a digit or a dagger between letters are
   misread near-certainly: they stand for any word of the corpus that the confusions lead to. Where
   several words are nearly as likely, the neighbours decide: the pairs of words (bigrams) that each
   candidate forms with the words before and after, as often as the corpus has them.
3. Lines are joined to paragraphs.

Null, empty and blank texts are no cases. Line ends alone aren't noise. The lexicon, the index and
the corrections are tables joined by key, never broadcast as a whole; a word's correction depends on
counts over all rows. What is joined in steps is written between them: all broadcasts of one plan are
in the driver's memory at once, those of a plan that ended aren't.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import map_text
from scriptorium.operators.skew import join_groups
from scriptorium.session import table, write_table

#: Shapes that scanners take for others, misread form first.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("c", "e"), ("e", "c"),
    ("b", "h"), ("h", "b"), ("0", "o"), ("O", "o"), ("1", "l"), ("I", "l"), ("l", "i"), ("i", "l"), ("1", "i"), ("l", "I"), ("5", "s"), ("8", "B"), ("9", "g"), ("6", "b"),
    ("(", "c"), ("†", "t"), ("ɑ", "a"), ("ſ", "s"), ("ƒ", "f"), ("í", "i"), ("ì", "i"), ("ı", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("0", "O"), ("|", "l"), ("!", "l"), ("@", "a"), ("$", "s"), ("€", "e"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("w", "vv"), ("nn", "rm"), ("tl", "d"), ("ß", "B"), ("q", "g"), ("y", "v"), ("f", "t"), ("t", "f"),
)
CHEAP, DEAR = 0.3, 1.0
MOST_COST = 0.95  # of a correction: up to three confusions, no arbitrary change
RATIO = 30  # a word is a misreading only if its correction is this many times as frequent
LEAST_DF = 5
IN_DOUBT = 0.35  # cost above the least up to which another word may be meant: one more confusion
CHANNEL = 15.0  # one confusion (CHEAP) more counts as a chance of 1 in 90
WORD_BITS = 20
LEAST_IN_DOCUMENT, LEAST_IN_CORPUS = 2, 3  # texts in which a header interrupts a sentence
_HYPHENS = "‐‑¬\xad-"
_BREAK = re.compile(rf"([^\W\d_][^\s{_HYPHENS}]*)[{_HYPHENS}][ \t]*\r?\n[ \t]*(?=([^\W\d_][^\s]*))")
_LINE_HYPHEN = re.compile(rf"[{_HYPHENS}][ \t]*\r?\n")
_COMPOUND = re.compile(r"(?<!\w)[^\W\d_]++(?:-[^\W\d_]++)+")
_TOKEN = re.compile(r"[^\s,.;:\"“”„«»?–—/\[\]{}<>*#=+|\\_~^%&-]+")
_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"[A-Z].*\d|\d.*[A-Z]|^[A-Z]{1,4}\d|\d{2,}")
_ORDINAL = re.compile(r"(?i)^\d+(?:st|nd|rd|th|er|re|ère|ème|[aehoslmgdx])$")
_INSIDE = re.compile(r"[^\W\d_][015689†ɑƒ]+[^\W\d_]")
_SPECIAL = set("0156789(†ɑſƒíìıﬁﬂﬀ|!@$")
#: Forms of page numbers. All other running lines are found by recurrence.
_PAGE = re.compile(
    r"^(?:\d{1,4}|[-–—\[(~*|]{1,2}\s*\d{1,4}\s*[-–—\])~*|]{1,2}"
    r"|[-–—\[(]?\s*(?:Page|PAGE|Seite|SEITE|Página|PÁGINA|Pagina|Pag|Pág|Folio|FOLIO|Blatt|Feuille|Hoja|[pPS](?=\.))\.?\s*\d{1,4}(?:\s*(?:of|OF|von|de|sur|/)\s*\d{1,4})?\s*[-–—\])]?"
    r"|\d{1,4}\s*(?:/|of|von|de|sur)\s*\d{1,4})$"
)
_LIST = re.compile(r"^\s*(?:[-*•>#|]|\d+[.)]\s|\(?[a-z]\)\s)")


def _plain(text: str) -> str:
    return re.sub(r"[\W\d_]+", " ", text).strip().casefold()


def running_lines(lines: list[str], title: str) -> list[int]:
    """The numbers of the lines that are page numbers, headers or footers between lines of running text."""
    name, out = _plain(title), []
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if len(filled) < 3 or not _is_running_text([lines[i] for i in filled]):
        return []
    for i in filled:
        line = lines[i].strip()
        if len(line) > 80 or line.startswith("#"):
            continue  # headings and page marks of the Markdown are no noise
        if _PAGE.match(line) or (name and len(name) > 5 and _plain(line) == name):
            out.append(i)
    return out


def _is_running_text(filled: list[str]) -> bool:
    """Whether filled lines are running text, of any width; menus, tables and lists of numbers aren't."""
    if sum(len(x.strip()) >= 25 and not _LIST.match(x) for x in filled) >= 0.4 * len(filled):
        return True
    plain = [x.strip() for x in filled if not _LIST.match(x) and len(x.split()) >= 2]
    onward = sum(x[:1].islower() for x in plain)
    return len(plain) >= 0.6 * len(filled) and onward >= 0.5 * len(plain) and onward >= 2


def mask(line: str) -> str:
    """A line as recurring ones are counted: numbers masked, case and signs aside."""
    return _plain(re.sub(r"[0-9]+|\b[IVXLC]+\b", " ", line))


def inserted_lines(lines: list[str]) -> list[tuple[int, bool]]:
    """(number, breaks): the short lines of running text that may be headers or footers.

    `breaks` tells that the text before stops within a sentence and goes on in lower case after the line,
    which therefore is no part of it: a line of the sentence itself would begin in lower case, or be
    filled up to the width of its neighbours. Lines that break nothing are headers only if they recur
    where they do.
    """
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if len(filled) < 3 or not _is_running_text([lines[i] for i in filled]):
        return []
    out = []
    for at, i in enumerate(filled):
        line = lines[i].strip()
        if len(line) > 80 or line[0] in "#|" or line[0].islower() or line[-1] in ",;:" or _LIST.match(line) or not mask(line):
            continue
        breaks = False
        if 0 < at < len(filled) - 1:
            before, after = filled[at - 1], filled[at + 1]
            first, last = lines[before].strip(), lines[after].strip()
            fits = len(line) + 1 + len(last.split()[0]) <= max(len(first), len(last))
            apart = fits or i - before > 1 or after - i > 1
            breaks = apart and first[0] not in "#|" and last[0] not in "#|" and first[-1] not in ".!?:;" and last[0].islower()
        out.append((i, breaks))
    return out


def _inserted(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"src_table": [], "row_id": [], "title": [], "h": [], "mask": [], "breaks": []}
    for k, text in enumerate(texts):
        lines = re.split(r"\r\n|\n|\r", text)
        for i, breaks in inserted_lines(lines):
            for name, value in (
                ("src_table", rest["src_table"][k]), ("row_id", rest["row_id"][k]), ("title", rest["document_name"][k]), ("h", rest["h"][k]),
                ("mask", mask(lines[i])), ("breaks", breaks),
            ):
                out[name].append(value)
    return out


def header_rows(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, headers): the masked lines of each row that interrupt the sentences of several texts, of its document or anywhere."""
    folded = F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", ""))
    wrapped = rows.where(F.col("text").rlike(r"[\r\n]")).select("src_table", "row_id", "document_name", folded.alias("h"), "text")
    found = write_table(map_text(wrapped, "src_table string, row_id long, title string, h long, mask string, breaks boolean", _inserted), "scan-inserted")
    parts = []
    for keys, least in ((["mask", "title"], LEAST_IN_DOCUMENT), (["mask"], LEAST_IN_CORPUS)):
        texts = found.groupBy(*keys, "h").agg(F.count("*").alias("n"), F.max(F.col("breaks").cast("int")).alias("breaks"))
        known = texts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("breaks").alias("texts")).where(F.col("texts") >= least).drop("texts")
        met = join_groups(found, write_table(known, "scan-recurring"), keys, "n").select("src_table", "row_id", "mask")
        parts.append(write_table(met, "scan-header-lines"))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("src_table", "row_id").agg(F.collect_set("mask").alias("headers"))


def clean_lines(text: str, title: str, headers: list[str] | None = None) -> tuple[list[str], bool]:
    """The lines without running lines (and without the blank lines around these), and whether there were any."""
    lines = re.split(r"\r\n|\n|\r", text)
    drop = set(running_lines(lines, title))
    if headers:
        drop.update(i for i, _ in inserted_lines(lines) if mask(lines[i]) in headers)
    if not drop:
        return lines, False
    for i in list(drop):
        for step in (-1, 1):
            j = i + step
            if 0 <= j < len(lines) and not lines[j].strip():
                drop.add(j)
    return [line for i, line in enumerate(lines) if i not in drop], True


def _pieces(text: str) -> list[tuple[str, str]]:
    """(first, second) parts of the words broken at line ends."""
    out = []
    for match in _BREAK.finditer(text):
        tail = _TOKEN.match(match.group(2))
        if tail and match.group(2)[0].islower():
            first = _TOKEN.findall(match.group(1))
            if first:
                out.append((first[-1], tail.group()))
    return out


class _Forms(dict):
    """Words as written to words as counted, '' for what isn't; kept as most words recur, within a bound."""

    def __init__(self, rule) -> None:
        super().__init__()
        self.rule = rule

    def __missing__(self, word: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        inner = word.strip("()'’!$€£")
        self[word] = form = inner.lower() if _LETTER.search(inner) and self.rule(inner) else ""
        return form


_forms: dict[str, _Forms] = {}


def _words_of(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    """Counts of words (and of hyphenated compounds) in a batch."""
    forms = _forms.setdefault("all", _Forms(lambda w: 1 < len(w) <= 40))
    counts: Counter[str] = Counter()
    shares: Counter[str] = Counter()
    for text, title, copies, headers in zip(texts, rest["document_name"], rest["copies"], rest["headers"]):
        lines, _ = clean_lines(text, title or "", headers)
        whole = "\n".join(lines)
        words = set(_COMPOUND.findall(whole)) if "-" in whole else set()
        joined = _BREAK.sub(lambda m: m.group(1), whole) if _LINE_HYPHEN.search(whole) else whole
        words.update(_TOKEN.findall(joined))
        own = {forms[w] for w in words}
        counts.update(own)
        if copies:
            for word in own:
                shares[word] += 1 / copies - 1
    counts.pop("", None)
    return {"word": list(counts), "df": [n + shares[w] for w, n in counts.items()], "n": list(counts.values())}


def copied_rows(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, copies): the rows whose letters and digits occur in other rows too, with the number of these rows; a written table."""
    folded = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    hashed = write_table(rows.select("src_table", "row_id", F.xxhash64(folded).alias("h")), "scan-hashes")
    sizes = write_table(hashed.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "scan-copies")
    return write_table(join_groups(hashed, sizes, ["h"], "copies").select("src_table", "row_id", "copies"), "scan-copied")


def lexicon(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(word, df, n): all words of the corpus in lower case with the numbers of different texts and of rows that hold them; a written table.

    headers: the result of `header_rows`, as a word may be broken around a running line.
    """
    row = ["src_table", "row_id"]
    headed = rows.join(headers, row, "left") if headers is not None else rows.withColumn("headers", F.lit(None).cast("array<string>"))
    weighed = headed.join(copied_rows(rows), row, "left").select("document_name", "text", "copies", "headers")
    counted = map_text(weighed, "word string, df double, n long", _words_of)
    return write_table(
        counted.groupBy("word").agg(F.ceil(F.sum("df") - 1e-6).alias("df"), F.sum("n").alias("n")).withColumn("df", F.greatest("df", F.lit(1))), "scan-lexicon"
    )


def deletes(word: str, most: int = 2) -> set[str]:
    """All strings that arise by deleting up to `most` characters."""
    out, now = {word}, {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out |= now
    return out


def _shapes() -> dict[int, str]:
    """Each character to the least one that single-character confusions lead to."""
    least: dict[str, str] = {}
    pairs = [(a.lower(), b.lower()) for a, b in CONFUSIONS if len(a) == len(b) == 1]
    for _ in pairs:
        for a, b in pairs:
            low = min(least.get(a, a), least.get(b, b))
            least[a] = least[b] = low
    return {ord(c): low for c, low in least.items()}


_SHAPE = _shapes()


def shape_key(word: str) -> str:
    """The same key for all words that differ by any number of single-character confusions."""
    return "\t" + word.translate(_SHAPE)


def seen_keys(word: str) -> set[str]:
    """The keys a word as read is looked up by."""
    return deletes(word) | {shape_key(word)}


SHORT = 7  # letters from which on a lexicon word is indexed with two deletions
_MERGED = tuple(dict.fromkeys(right for wrong, right in CONFUSIONS if len(right) == 2))


def lexicon_keys(word: str) -> set[str]:
    """The keys a word of the lexicon is found by: two deletions, of short words one, or the two letters that are read as one.

    A reading of one letter as two, or of two as one, is met with two deletions on one side and one on
    the other, several single letters by the shape: short words lose nothing that confusions of either kind
    lead to, and their keys stay specific.
    """
    if len(word) >= SHORT:
        return deletes(word) | {shape_key(word)}
    out = deletes(word, 1) | {shape_key(word)}
    for pair in _MERGED:
        at = word.find(pair)
        while at >= 0:
            out |= deletes(word[:at] + word[at + 2 :], 0)
            at = word.find(pair, at + 1)
    return {key for key in out if len(key) > 1}


def weighted_distance(seen: str, meant: str) -> float:
    """The least cost of edits that turn `meant` into `seen`; confusions are cheap."""
    n, m = len(seen), len(meant)
    costs = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best = float("inf")
            if i:
                best = costs[i - 1][j] + DEAR
            if j:
                best = min(best, costs[i][j - 1] + DEAR)
            if i and j:
                best = min(best, costs[i - 1][j - 1] + (0.0 if seen[i - 1] == meant[j - 1] else DEAR))
            for wrong, right in CONFUSIONS:
                a, b = len(wrong), len(right)
                if i >= a and j >= b and seen[i - a : i] == wrong and meant[j - b : j] == right:
                    best = min(best, costs[i - a][j - b] + CHEAP)
            costs[i][j] = best
    return costs[n][m]


def _indexer(keys):
    def index(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "word": [], "df": [], "n": []}
        for word, df, n in zip(texts, rest["df"], rest["n"]):
            for key in keys(word):
                for name, value in (("key", key), ("word", word), ("df", df), ("n", n)):
                    out[name].append(value)
        return out

    return index


def _misread_cost(seen: str, meant: str) -> float:
    """The weighted distance; transposed letters are slips of typing, never of reading."""
    return DEAR if sorted(seen) == sorted(meant) else weighted_distance(seen, meant)


def _score(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    return {
        "seen": texts, "meant": rest["meant"], "df": rest["df"], "meant_df": rest["meant_df"],
        "cost": [_misread_cost(a, b) for a, b in zip(texts, rest["meant"])],
    }


def _telling(word: str) -> bool:
    """Whether a rare word, as written, may be a misreading at all: codes, numbers, ordinals and short words without digits are not."""
    digits = [c for c in word if c.isdigit()]
    if len(word) >= 4 and not _CODE.search(word if digits else word.lower()):
        return True
    if not digits or not set(digits) <= set("015689") or _ORDINAL.match(word):
        return False
    letters = sum(c.isalpha() for c in word)
    if len(word) < 4:
        return word == word.lower() and len(digits) == 1 and digits[0] in "01" and letters == len(word) - 1
    cased = word[1:] == word[1:].lower() or (word == word.upper() and letters >= 3 and len(digits) == 1)
    return cased and letters >= max(2, len(digits))


def _only_telling(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    keep = [i for i, word in enumerate(texts) if _telling(word)]
    return {"word": [texts[i] for i in keep]} | {c: [rest[c][i] for i in keep] for c in ("df", "n")}


_READ_AS = {wrong: sorted({b.lower() for a, b in CONFUSIONS if a == wrong}) for wrong in "015689†ɑƒ"}


def readings(word: str) -> list[str]:
    """The words that one with digits or daggers between letters may stand for; none if it isn't of that shape."""
    odd = sum(c in _READ_AS for c in word)
    short = len(word) < 4 and odd == 1
    if not (short or _INSIDE.search(word)) or 2 * odd > len(word) or word.count("1") > 6:
        return []
    options = [_READ_AS.get(c, [c]) for c in word.lower()]
    return [w for w in map("".join, product(*options)) if not any(c.isdigit() for c in w)]


def _readings(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    pairs = [(word, meant) for word in texts for meant in readings(word)]
    return {"seen": [a for a, _ in pairs], "meant": [b for _, b in pairs], "cost": [CHEAP * sum(c in _READ_AS for c in a) for a, _ in pairs]}


def corrections(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((seen, meant), (seen, meant, cost, meant_df)): misread words and what they stand for, and all choices where it is in doubt; written tables."""
    frequent = words.where((F.col("n") >= LEAST_DF) & F.col("word").rlike(r"^[\p{L}’'-]{3,}$") & ~F.col("word").rlike("[†ɑſƒﬁﬂﬀı]"))
    telling = write_table(map_text(words.withColumnRenamed("word", "text"), "word string, df long, n long", _only_telling), "scan-telling")
    top, most = words.agg(F.max("df"), F.max("n")).first()
    rare = telling.where((F.col("df") * RATIO <= (top or 0)) | (F.col("n") * RATIO <= (most or 0)))
    index = "key string, word string, df long, n long"
    left = map_text(rare.select("df", "n", F.col("word").alias("text")), index, _indexer(seen_keys))
    right = map_text(frequent.select("df", "n", F.col("word").alias("text")), index, _indexer(lexicon_keys))
    often = (F.col("meant_df") >= F.col("df") * RATIO) | (F.col("meant_n") >= F.col("n") * RATIO)
    pairs = (  # the planner takes the index for as small as the words it is made of, and would broadcast it
        left.toDF("key", "text", "df", "n")
        .join(right.toDF("key", "meant", "meant_df", "meant_n").hint("merge"), "key")
        .where((F.col("text") != F.col("meant")) & often)
        .select("text", "meant", "df", "meant_df")
        .distinct()
    )
    scored = map_text(pairs, "seen string, meant string, df long, meant_df long, cost double", _score)
    shaped = map_text(telling.select(F.col("word").alias("text")), "seen string, meant string, cost double", _readings)
    sure = shaped.join(words.select(F.col("word").alias("meant"), F.col("df").alias("meant_df")), "meant")
    sure = sure.join(words.select(F.col("word").alias("seen"), "df"), "seen").where((F.length("seen") > 3) | (F.col("meant_df") >= F.col("df") * RATIO)).drop("df")
    likely = scored.where(F.col("cost") <= MOST_COST).select("seen", "meant", "cost", "meant_df").unionByName(sure)
    likely = write_table(likely.groupBy("seen", "meant").agg(F.min("cost").alias("cost"), F.max("meant_df").alias("meant_df")), "scan-likely")
    best = likely.groupBy("seen").agg(F.max_by("meant", F.struct(-F.col("cost"), "meant_df", "meant")).alias("meant"), F.min("cost").alias("_least"))
    near = likely.join(best.select("seen", "_least"), "seen").where(F.col("cost") <= F.col("_least") + IN_DOUBT).drop("_least")
    several = near.groupBy("seen").agg(F.count("*").alias("_c")).where("_c > 1").select("seen")
    return write_table(best.select("seen", "meant"), "scan-corrections"), write_table(near.join(several, "seen", "left_semi"), "scan-doubtful")


def word_bits(doubtful: DataFrame) -> np.ndarray:
    """A set of 2 ** WORD_BITS bits that marks the words in doubt and their candidates, whatever their number."""
    code = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << WORD_BITS) - 1)
    words = doubtful.select(F.explode(F.array("seen", "meant")).alias("word")).select(code.cast("int").alias("bit")).distinct()
    marks = np.zeros(1 << WORD_BITS, bool)
    marks[words.toArrow().column("bit").to_numpy()] = True  # at most 2 ** WORD_BITS numbers
    return np.packbits(marks)


class _Marked(dict):
    """Words as written to whether they, as counted, are marked in a set of bits."""

    def __init__(self, bits: np.ndarray, forms: _Forms) -> None:
        super().__init__()
        self.bits, self.forms = bits, forms

    def __missing__(self, word: str) -> bool:
        if len(self) >= 300_000:
            self.clear()
        code = zlib.crc32(self.forms[word].encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        self[word] = hit = bool(self.bits[code >> 3] & (128 >> (code & 7)))
        return hit


def _neighbours(tokens: list[str], different: set[str], marked: _Marked, forms: _Forms) -> list[dict[str, str]]:
    wanted = {t for t in different if marked[t]}
    if not wanted:
        return []
    ends = [forms[t] for t in tokens]
    return [
        {"word": ends[i], "prev": ends[i - 1] if i else "", "next": ends[i + 1] if i + 1 < len(ends) else ""} for i, t in enumerate(tokens) if t in wanted and ends[i]
    ]


def in_context(seen: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(src_table, row_id, seen, meant): for each row the candidate of a word in doubt that fits its neighbours there.

    seen: rows with `near`, the (word, prev, next) of the marked words. A candidate weighs by its
    frequency, the chance of its confusions, and of the words before and after given the candidate; where
    the corpus has none of these pairs, no row comes out.
    """
    near = seen.select("src_table", "row_id", F.explode("near").alias("w")).select("src_table", "row_id", "w.word", "w.prev", "w.next")
    left = near.groupBy(F.col("word").alias("meant"), "prev").agg(F.count("*").alias("before"))
    right = near.groupBy(F.col("word").alias("meant"), "next").agg(F.count("*").alias("after"))
    met = near.withColumnRenamed("word", "seen").join(doubtful, "seen").join(left, ["meant", "prev"], "left").join(right, ["meant", "next"], "left")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    weight = F.log((before + 0.1) * (after + 0.1) / (F.col("meant_df") + 1)) - CHANNEL * F.col("cost")
    scored = met.groupBy("src_table", "row_id", "seen", "meant").agg(F.sum(weight).alias("score"), F.sum(before + after).alias("pairs"))
    best = scored.groupBy("src_table", "row_id", "seen").agg(F.max_by("meant", F.struct("score", "meant")).alias("meant"), F.sum("pairs").alias("pairs"))
    return best.where("pairs > 0").drop("pairs")


def _evidence(shared):
    def find(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
        """For each row its distinct words, its broken words both ways, whether it has running lines, and the neighbours of words in doubt."""
        out: dict[str, list] = {"src_table": [], "row_id": [], "running": [], "words": [], "broken": [], "near": []}
        forms = _forms.setdefault("telling", _Forms(_telling))
        every = _forms.setdefault("all", _Forms(lambda w: 1 < len(w) <= 40))
        marked = _Marked(shared.value, every)
        for k, text in enumerate(texts):
            lines, running = clean_lines(text, rest["document_name"][k] or "", rest["headers"][k])
            whole = "\n".join(lines)
            broken = _pieces(whole) if _LINE_HYPHEN.search(whole) else []
            joined = _BREAK.sub(lambda m: m.group(1), whole) if broken else whole
            tokens = _TOKEN.findall(joined)
            different = set(tokens)
            words = {forms[w] for w in different}
            words.discard("")
            for name, value in (
                ("src_table", rest["src_table"][k]), ("row_id", rest["row_id"][k]), ("running", running), ("words", list(words)),
                ("broken", [{"joined": (a + b).lower(), "compound": f"{a}-{b}".lower()} for a, b in broken]),
                ("near", _neighbours(tokens, different, marked, every)),
            ):
                out[name].append(value)
        return out

    return find


_ROWS = (
    "src_table string, row_id long, running boolean, words array<string>, broken array<struct<joined: string, compound: string>>, "
    "near array<struct<word: string, prev: string, next: string>>"
)


def noise(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, running, fixes, broken): the noisy rows; a written table.

    rows: (src_table, row_id, document_name, text). fixes: the misread words of the row with their
    corrections; broken: the words broken at line ends, joined or as the compound they are.
    """
    marked = write_table(header_rows(rows), "scan-headers")
    words = lexicon(rows, marked)
    fixes, doubtful = corrections(words)
    headed = rows.select("src_table", "row_id", "document_name", "text").join(marked, ["src_table", "row_id"], "left")
    shared = rows.sparkSession.sparkContext.broadcast(word_bits(doubtful))  # 2 ** WORD_BITS bits
    seen = write_table(map_text(headed, _ROWS, _evidence(shared)), "scan-evidence")
    used = seen.select("src_table", "row_id", F.explode("words").alias("seen"))
    known = write_table(fixes.join(words.select(F.col("word").alias("seen"), F.col("n").alias("_n")), "seen"), "scan-known")
    fitting = write_table(in_context(seen, doubtful).withColumnRenamed("meant", "_fits"), "scan-fitting")
    misread = join_groups(used, known, ["seen"], "_n").join(fitting, ["src_table", "row_id", "seen"], "left")
    chosen = F.struct("seen", F.coalesce("_fits", "meant").alias("meant"))
    misread = write_table(misread.groupBy("src_table", "row_id").agg(F.collect_set(chosen).alias("fixes")), "scan-misread")
    parts = seen.select("src_table", "row_id", F.explode("broken").alias("b")).select("src_table", "row_id", "b.joined", "b.compound")
    df = words.select("word", "df")
    counts = parts.groupBy("joined", "compound").agg(F.count("*").alias("_n"))
    judged = (
        counts.join(df.toDF("joined", "joined_df"), "joined", "left")
        .join(df.toDF("compound", "compound_df"), "compound", "left")
        .select("joined", "compound", "_n", (F.coalesce("compound_df", F.lit(0)) > F.coalesce("joined_df", F.lit(0))).alias("kept"))
    )
    broken = join_groups(parts, write_table(judged, "scan-judged"), ["joined", "compound"], "_n").groupBy("src_table", "row_id").agg(
        F.max(~F.col("kept")).alias("has_break"), F.collect_set(F.when(F.col("kept"), F.col("compound"))).alias("compounds")
    )
    broken = write_table(broken, "scan-broken")
    every = seen.select("src_table", "row_id", "running").join(misread, ["src_table", "row_id"], "left").join(broken, ["src_table", "row_id"], "left")
    noisy = every.where(F.col("running") | F.col("fixes").isNotNull() | F.coalesce("has_break", F.lit(False)))
    noisy = noisy.join(marked, ["src_table", "row_id"], "left")
    return write_table(noisy.select("src_table", "row_id", "running", "fixes", "has_break", "compounds", "headers"), "scan-noise")


def repair_text(text: str, title: str, fixes: dict[str, str], compounds: set[str], headers: list[str] | None = None) -> str:
    """The text without running lines, with broken words joined, misread words corrected and lines joined to paragraphs."""
    lines, _ = clean_lines(text, title, headers)
    whole = "\n".join(lines)

    def join(match: re.Match[str]) -> str:
        tail = _TOKEN.match(match.group(2))
        first = _TOKEN.findall(match.group(1))
        if not tail or not first or not match.group(2)[0].islower():
            return match.group()
        compound = f"{first[-1]}-{tail.group()}".lower()
        return match.group(1) + ("-" if compound in compounds else "")

    whole = _BREAK.sub(join, whole)

    def fix(match: re.Match[str]) -> str:
        word = match.group()
        inner = word.strip("()'’!$€£")
        meant = fixes.get(inner.lower()) if _telling(inner) else None
        if not meant:
            return word
        if inner[:1].isupper() and inner[1:] == inner[1:].lower():
            meant = meant[:1].upper() + meant[1:]
        elif inner.isupper():
            meant = meant.upper()
        return word.replace(inner, meant, 1)

    if fixes:
        whole = _TOKEN.sub(fix, whole)
    out: list[str] = []
    for line in whole.split("\n"):
        line = line.rstrip()
        if not line.strip():
            out.append("")
        elif out and out[-1] and not _LIST.match(line) and not out[-1].startswith("#") and not out[-1].startswith("|"):
            out[-1] += " " + line.strip()
        else:
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def repair(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, text): the noisy rows with their text repaired."""

    def mend(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
        return {
            "src_table": rest["src_table"],
            "row_id": rest["row_id"],
            "text": [
                repair_text(t, n or "", {f["seen"]: f["meant"] for f in fixes or []}, set(compounds or []), headers)
                for t, n, fixes, compounds, headers in zip(texts, rest["document_name"], rest["fixes"], rest["compounds"], rest["headers"])
            ],
        }

    joined = rows.select("src_table", "row_id", "document_name", "text").join(
        noise(rows).select("src_table", "row_id", "fixes", "compounds", "headers"), ["src_table", "row_id"]
    )
    return map_text(joined, "src_table string, row_id long, text string", mend)


def titled_rows(spark, sf_dir: str) -> DataFrame:
    """(src_table, row_id, document_name, text) of chunk contents and vector texts."""
    chunks = table(spark, sf_dir, "rag_chunks").select(
        F.lit("rag_chunks").alias("src_table"), F.col("chunk_row").alias("row_id"), "document_name", F.col("content").alias("text")
    )
    vectors = table(spark, sf_dir, "vector_documents").select(
        F.lit("vector_documents").alias("src_table"), F.col("vec_row").alias("row_id"), "document_name", "text"
    )
    return chunks.unionByName(vectors)
