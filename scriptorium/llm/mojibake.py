"""Problem 10: texts decoded with a wrong character encoding.

1. Passages are keyed by their text without non-ASCII characters and with digits masked; garbled
   passages so meet their clean near-twins. The least garbled, most frequent variant of a key is
   taken as clean, the others are aligned with it word by word.
2. Each aligned pair votes for the transformation (true encoding, encoding it was read with) that
   turns the clean word into the garbled one; where neither looks garbled, for either direction, as a
   garbled variant may be the frequent one. Voted transformations are learned. Where none of the listed
   ones turns one into the other, the characters that face each other teach a map of their own.
3. Learned transformations are applied to the words of all documents. Where the true encoding is
   UTF-8 the byte pattern itself is proof, also of transformations not learned; where it is a
   single-byte encoding the restored word has to be a known word of the corpus and the found one has
   to be rarer, by different texts first, so that copies of a garbled document don't outvote clean ones. Words with replacement characters are restored by
   their aligned twins.

Null, empty and pure ASCII texts are never garbled. A document is reported once; what can't be
restored stays as it is, among that texts garbled twice by way of Greek or Cyrillic letters. Words shared by any number of documents are handled once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import map_text
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

LOST = "�"
ALIGNED = -2  # in place of a transformation: learned from aligned characters
LEAST_WORDS, LEAST_SHARE = 3, 0.8  # words that a character map must restore, and their share of all it applies to
#: Fixed values: (true encoding, encoding it was read with) that are considered.
TRANSFORMATIONS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"),
    ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "iso8859-15"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "latin-1"), ("cp850", "latin-1"),
    ("mac_roman", "latin-1"), ("cp1252", "koi8-r"), ("cp1252", "cp866"),
)
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ \t\r\n]+")
_EDGE = "()[]{}.,;:!?\"'*|/<>-"
_PASSAGE = re.compile(r"(?<=[.!?।])[ \t]+|[\r\n]+")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_SIGNS = frozenset("£€§¥¢")
_maps: dict[str, tuple[dict[str, int], list[str]]] = {}


def _codec(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character of a single-byte encoding; bytes without a character stand for themselves."""
    if name not in _maps:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _maps[name] = ({c: b for b, c in reversed(list(enumerate(chars)))}, chars)
    return _maps[name]


def garble(text: str, true: str, read: str) -> str | None:
    """What `text` becomes when its bytes in one encoding are read in the other."""
    chars = _codec(read)[1]
    try:
        if true == "utf-8":
            data = text.encode(true)
        else:
            own = _codec(true)[0]
            data = bytes(own[c] for c in text)
    except (KeyError, UnicodeEncodeError):
        return None
    return "".join(chars[b] for b in data)


#: Blocks of the characters that a single UTF-8 sequence may stand for. C1 controls are among
#: them, as a text garbled twice passes through them.
_BLOCKS = (
    (0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x900, 0x97F), (0x2000, 0x22FF), (0x2500, 0x27BF),
    (0xFB00, 0xFB06), (0xFE0F, 0xFE0F), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF),
)
#: Scripts whose letters are believed only two or more in a row, as a pair of ordinary letters
#: and quotation marks reads as one of them now and then: further Latin, Greek, Cyrillic, Armenian, Hebrew,
#: Arabic, scripts of India and beyond, Hangul, kana and ideographs.
_SCRIPTS = (
    (0x180, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x980, 0xDFF), (0xE00, 0x10FF),
    (0x1100, 0x1CFF), (0x1E00, 0x1FFF), (0x3000, 0x9FFF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF),
)


@lru_cache(100_000)
def _plausible(ch: str) -> int | None:
    """0 for a character that a UTF-8 sequence may stand for on its own, a script's number for one that needs company, else None."""
    code = ord(ch)
    if any(low <= code <= high for low, high in _BLOCKS):
        return 0
    return next((k for k, (low, high) in enumerate(_SCRIPTS, 1) if low <= code <= high), None)


def _restore_run(run: str, read: str) -> str | None:
    """A run of non-ASCII characters with its UTF-8 sequences decoded, or None if it holds none."""
    own = _codec(read)[0]
    if any(c not in own for c in run):
        parts = re.split("([" + re.escape("".join({c for c in run if c not in own})) + "])", run)
        done = [_restore_run(p, read) if p and all(c in own for c in p) else None for p in parts]
        return "".join(d or p for d, p in zip(done, parts)) if any(done) else None
    data = bytes(own[c] for c in run)
    found: list[tuple[int, int, str, int]] = []
    for match in _SEQUENCE.finditer(data):
        try:
            ch = match.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        script = _plausible(ch)
        if script is not None:
            found.append((match.start(), match.end(), ch, script))
    out, at = [], 0
    for k, (start, end, ch, script) in enumerate(found):
        before = k > 0 and found[k - 1][1] == start and found[k - 1][3] == script
        after = k + 1 < len(found) and found[k + 1][0] == end and found[k + 1][3] == script
        if script == 0 or before or after:
            out.append(run[at:start] + ch)
            at = end
    return "".join(out) + run[at:] if out else None


def restore_utf8(word: str, read: str) -> str | None:
    """A word with all its runs restored from UTF-8 read as `read`, up to three times over; None if nothing changed."""
    now = word
    for _ in range(3):
        new = _RUN.sub(lambda m: _restore_run(m.group(), read) or m.group(), now)
        if new == now:
            break
        now = new
    return now if now != word else None


def restore_single(word: str, true: str, read: str) -> str | None:
    """A word read with the wrong single-byte encoding, read with the true one; None if impossible or unchanged."""
    own, chars = _codec(read)[0], _codec(true)[1]
    if any(c not in own for c in word):
        return None
    new = "".join(c if c < "\x80" else chars[own[c]] for c in word)
    letters = all(unicodedata.category(c)[0] in "LPSN" for c in new if c >= "\x80")
    return new if new != word and letters else None


@lru_cache(100_000)
def _looks_garbled(run: str) -> bool:
    """Whether a run of non-ASCII characters holds UTF-8 sequences read in some other encoding."""
    return any(_restore_run(run, read) for true, read in TRANSFORMATIONS if true == "utf-8")


def _suspicion(text: str) -> int:
    """How many runs of a text look garbled: lost characters, or UTF-8 sequences read otherwise."""
    return text.count(LOST) + sum(map(_looks_garbled, _RUN.findall(text)))


def _passages(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    keys, passages, bad, own = [], [], [], []
    for h, text in zip(rest["h"], texts):
        for passage in {re.sub(r"[0-9]+", "0", p) for p in _PASSAGE.split(text) if p and not p.isascii()}:
            bare = _RUN.sub("", passage)
            if len(bare) >= 12:
                keys.append(zlib.crc32(bare.encode()) << 31 ^ zlib.adler32(bare.encode()) ^ len(bare) << 24)
                passages.append(passage)
                bad.append(_suspicion(passage))
                own.append(h)
    return {"key": keys, "passage": passages, "bad": bad, "h": own}


def _votes(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"word": [], "clean": [], "how": [], "n": []}
    for found, clean, n in zip(rest["found"], texts, rest["n"]):
        if _RUN.sub("", found) != _RUN.sub("", clean):
            continue
        a, b = _WORD.findall(found), _WORD.findall(clean)
        if len(a) != len(b):
            continue
        for x, y in zip(a, b):
            x, y = x.strip(_EDGE), y.strip(_EDGE)
            if x == y or x.isascii() or y.isascii():
                continue
            how = next((k for k, (true, read) in enumerate(TRANSFORMATIONS) if _turns(y, x, true, read)), -1)
            for k, (true, read) in enumerate(TRANSFORMATIONS):
                if true != "utf-8" and k != how and (_turns(x, y, true, read) or _turns(y, x, true, read)):
                    for name, value in (("word", y), ("clean", x), ("how", k), ("n", n)):
                        out[name].append(value)
            if how >= 0 or LOST in x:
                for name, value in (("word", x), ("clean", y), ("how", how), ("n", n)):
                    out[name].append(value)
            elif aligned(x, y):
                # no listed transformation: either may be the garbled one
                for name, values in (("word", (x, y)), ("clean", (y, x)), ("how", (ALIGNED, ALIGNED)), ("n", (n, n))):
                    out[name] += values
    return out


def aligned(found: str, clean: str) -> list[tuple[str, str]]:
    """The runs of non-ASCII characters of two words that face each other between the same ASCII characters; [] if they don't."""
    if _RUN.split(found) != _RUN.split(clean):
        return []
    return [(a, b) for a, b in zip(_RUN.findall(found), _RUN.findall(clean)) if a != b]


def _alignments(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    rows = [(run, meant, word) for word, clean in zip(texts, rest["clean"]) for run, meant in set(aligned(word, clean))]
    return {"run": [r[0] for r in rows], "meant": [r[1] for r in rows], "word": [r[2] for r in rows]}


def _runs_of(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    rows = [(word, run) for word in texts for run in set(_RUN.findall(word))]
    return {"word": [r[0] for r in rows], "run": [r[1] for r in rows]}


def _apply_maps(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    out = []
    for word, maps in zip(texts, rest["maps"]):
        known = {m["run"]: m["meant"] for m in maps}
        out.append(_RUN.sub(lambda m, known=known: known.get(m.group(), m.group()), word))
    return {"word": texts, "restored": out, "runs": [[m["run"] for m in maps] for maps in rest["maps"]]}


def learned_maps(votes: DataFrame, counted: DataFrame) -> DataFrame:
    """(word, restored): words restored by character maps that alignments teach, whatever encodings caused them.

    A run of characters is mapped to the one that faces it in most aligned words, LEAST_WORDS at least.
    The map holds if it leads nearly all words of the corpus with that run to words that more texts
    have: accents that merely differ between words or spellings don't pass that.
    """
    pairs = votes.where(F.col("how") == ALIGNED).select(F.col("word").alias("text"), "clean").distinct()
    facing = map_text(pairs, "run string, meant string, word string", _alignments).distinct()
    support = facing.groupBy("run", "meant").agg(F.count("*").alias("words")).where(F.col("words") >= LEAST_WORDS)
    maps = write_table(support.groupBy("run").agg(F.max_by("meant", F.struct("words", "meant")).alias("meant")), "character-maps")
    runs = map_text(counted.select(F.col("word").alias("text")), "word string, run string", _runs_of)
    mapped = runs.join(maps, "run").groupBy("word").agg(F.collect_list(F.struct("run", "meant")).alias("maps"))
    tried = map_text(mapped.withColumnRenamed("word", "text"), "word string, restored string, runs array<string>", _apply_maps)
    texts = counted.select("word", "texts")
    tried = tried.join(texts, "word").join(texts.toDF("restored", "known_texts"), "restored", "left")
    tried = write_table(tried.withColumn("good", F.coalesce(F.col("known_texts") > F.col("texts"), F.lit(False))), "mapped-words")
    judged = tried.select(F.explode("runs").alias("run"), "good").groupBy("run").agg(F.count_if("good").alias("right"), F.count("*").alias("all"))
    wrong = judged.where((F.col("right") < LEAST_WORDS) | (F.col("right") < LEAST_SHARE * F.col("all"))).select("run")
    bad = tried.select("word", F.explode("runs").alias("run")).join(wrong, "run").select("word").distinct()
    return tried.where("good").join(bad, "word", "left_anti").select("word", "restored")


def _turns(clean: str, found: str, true: str, read: str) -> bool:
    once = garble(clean, true, read)
    return once is not None and (once == found or garble(once, true, read) == found)


def _document_words(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    ids, words, amount, own = [], [], [], []
    for key, h, text in zip(rest["doc_id"], rest["h"], texts):
        seen = {}
        for match in _WORD.finditer(text):
            word = match.group().strip(_EDGE)
            if word and not word.isascii():
                before_number = text[match.end() : match.end() + 2].strip()[:1].isdigit()
                seen[word] = seen.get(word, False) or before_number
        ids += [key] * len(seen)
        words += seen
        amount += seen.values()
        own += [h] * len(seen)
    return {"doc_id": ids, "word": words, "amount": amount, "h": own}


def _unlearned(word: str, reads: list[str]) -> tuple[bool, str | None]:
    """Whether a word holds UTF-8 sequences read in one of the encodings, and what it stands for if that is certain.

    Words of letters without any ASCII one are left: ordinary Cyrillic words look like this too.
    """
    if all(c.isalpha() for run in _RUN.findall(word) for c in run) and not re.search("[A-Za-z]", word):
        return False, None
    news = {new for read in reads if (new := restore_utf8(word, read))}
    least = [new for new in news if len(new) == min(map(len, news))]
    return bool(news), least[0] if len(least) == 1 else None


def _candidates(learned: list[int]):
    others = [read for k, (true, read) in enumerate(TRANSFORMATIONS) if true == "utf-8" and k not in learned]

    def find(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "restored": [], "proof": [], "how": [], "df": []}

        def add(word: str, restored: str, proof: str, how: int, df: int) -> None:
            for name, value in (("word", word), ("restored", restored), ("proof", proof), ("how", how), ("df", df)):
                out[name].append(value)

        for word, df, amount in zip(texts, rest["df"], rest["amount"]):
            best = None
            for k in learned:
                true, read = TRANSFORMATIONS[k]
                if true == "utf-8":
                    new = restore_utf8(word, read)
                    if new and (best is None or len(new) < len(best)):
                        best = new
            if best is not None:
                add(word, best, "bytes", -1, df)
                continue
            garbled, best = _unlearned(word, others)
            if garbled:
                add(word, best, "bytes", -1, df)
                continue
            for k in learned:
                true, read = TRANSFORMATIONS[k]
                if true != "utf-8" and (new := restore_single(word, true, read)):
                    if len(re.findall("[A-Za-z]", word)) >= 2:
                        add(word, new, "lexicon", k, df)
                    elif amount and len(word) == 1 and new in _SIGNS and unicodedata.category(word)[0] == "L":
                        add(word, new, "sign", k, df)
        return out

    return find


def _restore_texts(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    """Known words are replaced; where a passage holds words of one single-byte transformation, so are its other words."""
    out = []
    for pairs, text in zip(rest["pairs"], texts):
        known = {p["word"]: (p["restored"], p["how"]) for p in pairs}
        done, at = [], 0
        for end in [*(m.end() for m in _PASSAGE.finditer(text)), len(text)]:
            passage = text[at:end]
            at = end
            if passage.isascii():
                done.append(passage)
                continue
            inner = [m.strip(_EDGE) for m in _WORD.findall(passage)]
            hows = Counter(known[w][1] for w in inner if w in known and known[w][1] >= 0)
            rule = TRANSFORMATIONS[hows.most_common(1)[0][0]] if hows else None

            def one(match: re.Match[str], known: dict = known, rule: tuple[str, str] | None = rule) -> str:
                whole = match.group()
                word = whole.strip(_EDGE)
                if rule and not word.isascii():
                    new = restore_single(word, *rule)
                else:
                    new = None
                if word in known and (new is None or known[word][1] < 0):
                    new = known[word][0]
                return whole.replace(word, new, 1) if new else whole

            done.append(_WORD.sub(one, passage))
        out.append("".join(done))
    return {"doc_id": rest["doc_id"], "text": out}


def learn(documents: DataFrame) -> tuple[DataFrame, list[int]]:
    """The aligned (word, clean, how, n) pairs of near-twins, and which TRANSFORMATIONS they vote for."""
    passages = map_text(documents.select("h", "text"), "key long, passage string, bad int, h long", _passages)
    once = passages.groupBy("key", "passage", "bad", "h").agg(F.lit(1).alias("one"))
    variants = write_table(once.groupBy("key", "passage", "bad").agg(F.count("*").alias("n")), "passages")
    cleanest = (
        variants.groupBy("key")
        .agg(
            F.min_by("passage", F.struct("bad", -F.col("n"), "passage")).alias("clean"), F.count("*").alias("variants")
        )
        .where(F.col("variants") > 1)
    )
    pairs = join_groups(variants, cleanest, ["key"], "variants").where(F.col("passage") != F.col("clean"))
    voted = map_text(
        pairs.select(F.col("passage").alias("found"), "n", F.col("clean").alias("text")),
        "word string, clean string, how int, n long",
        _votes,
    )
    votes = write_table(voted.groupBy("word", "clean", "how").agg(F.sum("n").alias("n")), "twin-votes")
    learned = [r["how"] for r in votes.where("how >= 0").select("how").distinct().collect()]  # at most the fixed list
    return votes, sorted(learned)


def word_map(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(word, restored, how): what garbled words stand for, and by which single-byte transformation (else -1).

    `restored` is null where that is unknown.
    """
    votes, learned = learn(documents)
    once = words.groupBy("word", "h").agg(F.count("*").alias("df"), F.max("amount").alias("amount"))
    counted = write_table(
        once.groupBy("word").agg(F.sum("df").alias("df"), F.count("*").alias("texts"), F.max("amount").alias("amount")), "word-counts"
    )
    found = write_table(
        map_text(
            counted.withColumnRenamed("word", "text"),
            "word string, restored string, proof string, how int, df long",
            _candidates(learned),
        ),
        "restorations",
    )
    known = counted.select(F.col("word").alias("restored"), F.col("df").alias("known"), F.col("texts").alias("known_texts"))
    taught = learned_maps(votes, counted).select("word", "restored", F.lit("lexicon").alias("proof"), F.lit(ALIGNED).alias("how"), F.lit(0).cast("long").alias("df"))
    taught = taught.drop("df").join(counted.select("word", "df"), "word").select(*found.columns)
    single = found.where(F.col("proof") == "lexicon").unionByName(taught)
    weighed = single.join(known, "restored").join(counted.select("word", "texts"), "word").where(F.col("known") >= 2)
    more = F.struct("known_texts", "known") > F.struct("texts", "df")
    # more documents with fewer different texts count only if the opposite isn't possible
    opposite = single.select(F.col("word").alias("restored"), F.col("restored").alias("word"))
    copied = weighed.where(~more & (F.col("known") > F.col("df"))).join(opposite, ["word", "restored"], "left_anti")
    lexicon = (
        weighed.where(more)
        .unionByName(copied)
        .groupBy("word")
        .agg(F.max_by(F.struct("restored", "how"), F.struct("known", "restored", "how")).alias("r"))
    )
    sure = found.where(F.col("proof") != "lexicon").groupBy("word").agg(F.min(F.struct("restored", "how")).alias("r"))
    lost_words = counted.where(F.col("word").contains(LOST)).select("word")
    voted = votes.where(F.col("word").contains(LOST) & F.col("word").rlike("[A-Za-z]")).select("word", "clean", (F.col("n") * 1000).alias("n"))
    shape = F.regexp_replace("word", r"[^\x00-\x7f]", LOST)
    fitting = lost_words.join(
        counted.where(~F.col("word").contains(LOST) & (F.col("df") >= 2) & F.col("word").rlike("[A-Za-z]"))
        .join(found.select("word").distinct(), "word", "left_anti")
        .select(shape.alias("shape"), F.col("word").alias("clean"), F.col("df").alias("n"))
        .withColumnRenamed("shape", "word"),
        "word",
    )
    best = voted.unionByName(fitting).groupBy("word").agg(F.max_by("clean", F.struct("n", "clean")).alias("restored"))
    lost = lost_words.join(best, "word", "left").select("word", F.struct("restored", F.lit(-1).alias("how")).alias("r"))
    every = sure.unionByName(lexicon).unionByName(lost).groupBy("word").agg(F.max("r").alias("r"))
    return every.select("word", "r.restored", "r.how")


def garbled_words(documents: DataFrame) -> DataFrame:
    """(doc_id, word, restored, how) of each garbled word of each document, as a written table."""
    odd = documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(
        "doc_id", F.xxhash64(F.regexp_replace("text", r"\s+", "")).alias("h"), "text"
    )
    words = write_table(map_text(odd, "doc_id long, word string, amount boolean, h long", _document_words), "document-words")
    mapping = write_table(word_map(odd, words), "word-map")
    signs = F.length("word") > 1
    usable = words.where(signs | F.col("amount") | F.col("word").contains(LOST))
    counts = usable.groupBy("word").agg(F.count("*").alias("_n"))
    return write_table(
        join_groups(usable, mapping.join(counts, "word"), ["word"], "_n").select("doc_id", "word", "restored", "how"), "garbled-words"
    )


def restore(documents: DataFrame) -> DataFrame:
    """(doc_id, text, restored): each garbled document with as much of its original text as is known."""
    garbled = garbled_words(documents)
    pairs = garbled.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("restored").isNotNull(), F.struct("word", "restored", "how"))).alias("pairs")
    )
    joined = documents.select("doc_id", "text").join(pairs, "doc_id")
    return map_text(joined, "doc_id long, text string", _restore_texts)
