"""Problem 4: rows that share most of their content, found with a min-hash LSH forest.

Every row gets TREES labels, each a string of min-hash values over its runs of three words: SHORTEST
values hashed to a number, then four more levels of four bits each. A label is one key, so that a
sort of the keys is a trie: rows that share a prefix lie side by side, and the bits two keys agree in
tell how deep. The tries are dealt out by node to as many tasks as keep each below PART_KEYS keys on
average, and travel as packed arrays, so that no row is made per key. One sorted walk finds all pairs that share at least SHORTEST levels, with the longest
prefix they share in any tree. SHORTEST is where a pair at the threshold itself meets with the
probability LEAST_RECALL. Sketches, sets of bits of a row's shingles, bound from above how many shingles
two rows share and leave out only pairs that can't reach the threshold; all others are verified by the
exact share of common shingles, at whatever depth they met and whatever other pairs there are. Which
longer prefix would have served can be measured (`depth_reached`), but leaves nothing out.

Nodes of more than WIDE rows are compared in blocks of rows spread over the tasks, by their sketches,
so that no task compares a whole node and no impossible pair is ever written. All pairs of a node are
compared whatever its size; nodes of more than DEEP rows have larger blocks, so that their rows are sent
less often.

Rows with the same sequence of words form a class, and only one row of a class enters the forest;
pairs are found between classes and expanded to rows where the result asks for rows.

Null, empty and short texts (under `min_words` words) are in no pair. Extra columns are ignored. There
may be up to MOST_TABLES values of src_table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textcore as core
from scriptorium.llm.frames import likely_rows, map_batches, map_text, slices
from scriptorium.operators.components import connected_components
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

MIN_WORDS = 30
SHINGLE = 3
THRESHOLD = (3, 5)  # the least share of common shingles, as an exact fraction
TREES = 48
FULL_DEPTH = 9
LEAST_RECALL = 0.97  # of pairs at the threshold
TARGET_RECALL = 0.998  # of all pairs, as measured
WIDE, DEEP = 1_000, 8_192
BLOCK, DEEP_BLOCK = 1_024, 16_384
MOST_TABLES = 1024
SKETCH_BITS = 512
SIGN_CHARS = 300_000  # handled at once, so that arrays stay in the cache
PART_KEYS, FEW_KEYS = 1 << 20, 1 << 16  # keys a task sorts on average, at most and at least
#: Similarity is counted in SKETCH parts when recall is measured, from SKETCH_LIKELY on.
SKETCH, SKETCH_LIKELY = 32, 14

_SCHEMA = (
    "src_table string, row_id long, w1 long, w2 long, k1 long, k2 long, f1 long, f2 long, "
    "n int, labels array<long>, sketch binary"
)
CLASS = ["src_table", "w1", "w2", "f1", "f2"]


def depth_for_recall(threshold: float, trees: int, target: float, deepest: int = FULL_DEPTH) -> int:
    """The longest prefix at which a pair of this similarity shares one in some tree with the target probability."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


SHORTEST = depth_for_recall(THRESHOLD[0] / THRESHOLD[1], TREES, LEAST_RECALL)


def _labels(values: np.ndarray) -> np.ndarray:
    """(rows, TREES) labels of 48 bits: a hash of SHORTEST values, then four bits for each further level.

    The further levels of a tree take the values of another one: within a tree all are different functions.
    """
    blocks = values.reshape(len(values), TREES, SHORTEST).astype(np.uint64)
    label = np.zeros((len(values), TREES), np.uint64)
    for level in range(SHORTEST):
        label = core.mix(label * core.U64(0x9E3779B97F4A7C15) + blocks[:, :, level] + core.U64(1))
    label >>= core.U64(32)
    other = np.roll(blocks, 17, axis=1)
    for level in range(FULL_DEPTH - SHORTEST):
        label = label << core.U64(4) | core.mix(other[:, :, level]) & core.U64(15)
    return label


def _sketches(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, SKETCH_BITS / 8) bytes: the set of bits that each row's shingles fall on."""
    bits = np.zeros((len(counts), SKETCH_BITS), bool)
    bits[np.repeat(np.arange(len(counts)), counts), (grams >> core.U64(20)) & core.U64(SKETCH_BITS - 1)] = True
    return np.packbits(bits, axis=1)


def _unpacked(sketches: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches as (rows, SKETCH_BITS / 64) words, and by how many a row's shingles outnumber its bits."""
    words = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, SKETCH_BITS // 64)
    return words, n.astype(np.int32) - np.bitwise_count(words).sum(axis=1, dtype=np.int32)


def _signer(more: list[str], shingle: int, min_words: int):
    def sign(rest: dict[str, list], texts: list[str]) -> dict[str, object]:
        fold = core.folded(texts)
        word_hashes, n_words = core.words(texts, fold)
        keep = np.flatnonzero(n_words >= min_words)
        w1 = core.sequence_hash(word_hashes, n_words)
        w2 = core.sequence_hash(core.mix(word_hashes ^ core.U64(0x5851F42D4C957F2D)), n_words)
        grams, counts = core.shingles(word_hashes, n_words, shingle)
        grams, counts = core.distinct_per_text(grams, counts)
        values = core.minhash(grams, counts, TREES * SHORTEST)[keep]
        sketch = _sketches(grams, counts)[keep]
        k1, k2 = core.rolling_hashes(texts, fold)
        f1, f2, mask = core.field_hashes(texts)
        f1, f2 = np.where(mask, f1, 0), np.where(mask, f2, 0)
        return {
            "n": counts[keep].astype(np.int32),
            "labels": list(_labels(values).view(np.int64)),
            "sketch": [s.tobytes() for s in sketch],
        } | {c: [rest[c][i] for i in keep] for c in ("src_table", "row_id", *more)} | {
            name: core.signed(np.ascontiguousarray(x))[keep]
            for name, x in (("w1", w1), ("w2", w2), ("k1", k1), ("k2", k2), ("f1", f1), ("f2", f2))
        }

    return sign


def signatures(rows: DataFrame, more: str | None = None, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """Hashes, labels and sketch of each row with enough words, and its int column `more`, as a written table."""
    extra = [more] if more else []
    schema = _SCHEMA + "".join(f", {c} int" for c in extra)
    signed = map_text(rows.select("src_table", "row_id", *extra, "text"), schema, _signer(extra, shingle, min_words), chars=SIGN_CHARS)
    return write_table(signed, "signatures")


def classes_of(signed: DataFrame, *more) -> DataFrame:
    """One row per class of equal word sequences: its smallest key `rep`, its number of rows `n_rows`."""
    return signed.groupBy(*CLASS).agg(F.min("row_id").alias("rep"), F.count("*").alias("n_rows"), *more)


def _pack(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Integers as their least, and the rest in as few bytes as the largest needs."""
    least = int(values.min())
    rest = (values - least).view(np.uint64)  # right also where the difference wraps
    kind = np.min_scalar_type(int(rest.max()))
    return least, kind.itemsize, rest.astype(kind)


def _unpack(least: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{width}").astype(np.uint64).view(np.int64) + np.int64(least)


_PACKED = "part int, row_least long, row_width int, ord_least long, ord_width int, keys binary, rows binary, ords binary"


def _dealer(parts: int):
    """The keys of all tries of a batch of (row_id, ord, code, labels), dealt out by node to `parts` tasks, as `_PACKED`."""
    kind = np.uint16 if parts <= 1 << 16 else np.uint32
    trees = (np.arange(TREES, dtype=np.int64) * MOST_TABLES)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("labels").flatten().to_numpy().reshape(-1, TREES)
            row, ord_, code = (batch.column(c).to_numpy() for c in ("row_id", "ord", "code"))
            # one number orders the tries: tree, table, label
            keys = (((trees + code[:, None]) << np.int64(48)) + labels).ravel()
            part = (core.mix((keys >> np.int64(16)).view(np.uint64)) % np.uint64(parts)).astype(kind)
            order = np.argsort(part, kind="stable")
            keys, owner = keys[order], order // TREES
            bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            (row_least, row_width, row), (ord_least, ord_width, ord_) = _pack(row), _pack(ord_.astype(np.int64))
            row, ord_ = row[owner], ord_[owner]
            own = [i for i in range(parts) if bounds[i] < bounds[i + 1]]
            sides = [[x[bounds[i] : bounds[i + 1]].tobytes() for i in own] for x in (keys, row, ord_)]
            wide = [pa.array(np.full(len(own), v, k)) for v, k in ((row_least, np.int64), (row_width, np.int32), (ord_least, np.int64), (ord_width, np.int32))]
            columns = [pa.array(np.array(own, np.int32)), *wide, *(pa.array(x, pa.binary()) for x in sides)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "row_least", "row_width", "ord_least", "ord_width", "keys", "rows", "ords"])

    return run


def _walker(ordered: bool, floor: int, wide: int):
    """A walk over the keys of a task in order: pairs of narrow nodes, members of wide ones."""
    low = np.int64((1 << 16) - 1)

    def batch_of(code, a, b, depth, node) -> pa.RecordBatch:
        n = len(a)
        columns = [
            pa.array(code.astype(np.int32)), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b),
            pa.nulls(n, pa.int32()) if depth is None else pa.array(depth.astype(np.int32)), pa.nulls(n, pa.int64()) if node is None else pa.array(node),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["code", "a", "b", "depth", "node"])

    def process(keys: np.ndarray, rows: np.ndarray, ords: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = keys >> np.int64(16)
        code = (nodes >> np.int64(32)) & np.int64(MOST_TABLES - 1)
        starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        for size in np.unique(sizes[sizes > 1]).tolist():
            own = starts[sizes == size]
            if size > wide:
                for x in own.tolist():
                    y = x + size
                    yield batch_of(code[x:y], rows[x:y], None, None, np.full(size, nodes[x]))
                continue
            i, j = np.triu_indices(size, 1)
            step = max(1, 2_000_000 // len(i))
            for at in range(0, len(own), step):
                base = own[at : at + step, None]
                x, y = (base + i).ravel(), (base + j).ravel()
                if ordered:
                    good = (ords[x] != ords[y]) & (np.maximum(ords[x], ords[y]) >= floor)
                    x, y = x[good], y[good]
                    swap = ords[x] > ords[y]
                else:
                    swap = rows[x] > rows[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                differ = (keys[x] ^ keys[y]) & low
                depth = SHORTEST + sum((differ < 1 << bits).astype(np.int32) for bits in (12, 8, 4, 0))
                if x.size:
                    yield batch_of(code[x], rows[x], rows[y], depth, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for x in batch.to_pylist():
                rows, ords = (_unpack(x[f"{c}_least"], x[f"{c}_width"], x[f"{c}s"]) for c in ("row", "ord"))
                held.append((np.frombuffer(x["keys"], np.int64), rows, ords.astype(np.int32)))
        if held:
            keys, rows, ords = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys)
            yield from process(keys[order], rows[order], ords[order])

    return run


def _blocks(ordered: bool, floor: int):
    """The pairs of two blocks of a wide node whose sketches let them reach the threshold."""
    num, den = THRESHOLD

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, ords, block, n = (table.column(c).to_numpy() for c in ("a", "ord", "own", "n"))
        i, j, code = (table.column(c)[0].as_py() for c in ("i", "j", "code"))
        words, spare = _unpacked(table.column("sketch").to_pylist(), n)
        need = num * n.astype(np.int32)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        new = ords >= floor
        if ordered:  # old rows last, as two of them needn't be compared
            left, right = (side[np.argsort(~new[side], kind="stable")] for side in (left, right))
        sides = [np.ascontiguousarray(words[side].T) for side in (left, right)]
        both, ones = np.empty((64, 1024), np.uint64), np.empty((64, 1024), np.uint8)
        for x0 in range(0, len(left), 64):
            for y0 in range(0, len(right), 1024):
                some, other = left[x0 : x0 + 64], right[y0 : y0 + 1024]
                if ordered and not (new[some].any() or new[other].any()):
                    break
                common = np.minimum(spare[some][:, None], spare[other][None, :])
                u, v = both[: len(some), : len(other)], ones[: len(some), : len(other)]
                for a, b in zip(sides[0][:, x0 : x0 + 64, None], sides[1][:, None, y0 : y0 + 1024]):
                    np.bitwise_and(a, b, out=u)
                    np.bitwise_count(u, out=v)
                    common += v
                x, y = np.nonzero(common * (num + den) >= need[some][:, None] + need[other][None, :])
                x, y = some[x], other[y]
                good = ids[x] < ids[y] if i == j else ids[x] != ids[y]
                if ordered:
                    good &= (ords[x] != ords[y]) & (np.maximum(ords[x], ords[y]) >= floor)
                x, y = x[good], y[good]
                if x.size:
                    swap = ords[x] > ords[y] if ordered else ids[x] > ids[y]
                    same = [pa.array(np.full(x.size, v, np.int32)) for v in (code, SHORTEST)]
                    a, b = np.where(swap, ids[y], ids[x]), np.where(swap, ids[x], ids[y])
                    yield pa.RecordBatch.from_arrays([same[0], pa.array(a), pa.array(b), same[1]], names=["code", "a", "b", "depth"])

    return compare


def candidate_pairs(reps: DataFrame, order: str | None = None, floor: int = 0, wide: int = WIDE, deep: int | None = DEEP) -> DataFrame:
    """(src_table, a, b, depth): pairs of rows that share a prefix in some tree, once each, with the longest; a written table.

    reps: (src_table, row_id, labels, n, sketch); with `order`, an int column, only pairs whose value of it
    differs and is from `floor` on in one of them are made, the one with the smaller value first. `wide`
    and `deep` (None: no node is deep) change how a node is compared, never what is found.
    """
    sizes = {r["src_table"]: r["count"] for r in reps.groupBy("src_table").count().collect()}  # a row a table
    names = sorted(sizes)
    if len(names) > MOST_TABLES:
        raise ValueError(f"more than {MOST_TABLES} tables")
    codes = reps.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "src_table string, code int")
    code = F.coalesce(*(F.when(F.col("src_table") == n, i) for i, n in enumerate(names)), F.lit(0)).cast("long")
    ord_ = (F.col(order) if order else F.lit(0)).cast("int").alias("ord")
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_keys = sum(sizes.values()) * TREES
    parts = max(min(tasks, 1 + n_keys // FEW_KEYS), -(-n_keys // PART_KEYS))
    dealt = reps.select("row_id", ord_, code.alias("code"), "labels").mapInArrow(_dealer(parts), _PACKED)
    walked = dealt.repartitionById(parts, "part").mapInArrow(_walker(bool(order), floor, wide), "code int, a long, b long, depth int, node long")
    met = write_table(walked.groupBy("code", "a", "b", "node").agg(F.max("depth").alias("depth")), "near-met")
    pairs = met.where(F.col("b").isNotNull()).select("code", "a", "b", "depth")
    members = met.where(F.col("node").isNotNull()).select("code", "node", "a")
    if members.limit(1).count():
        sizes = members.groupBy("node").agg(F.count("*").alias("_m"))
        rows = F.lit(BLOCK) if deep is None else F.when(F.col("_m") > deep, DEEP_BLOCK).otherwise(BLOCK)
        known = join_groups(members, sizes, ["node"], "_m").withColumn("blocks", F.ceil(F.col("_m") / rows).cast("int"))
        known = known.withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        side = reps.select(code.cast("int").alias("code"), F.col("row_id").alias("a"), ord_, "n", "sketch")
        spread = known.join(side, ["code", "a"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("code", "node", "a", "ord", "n", "sketch", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        # a fixed number of tasks, as few bytes are much work here
        spread = spread.repartition(tasks, "code", "node", "i", "j")
        blocks = spread.groupBy("code", "node", "i", "j").applyInArrow(_blocks(bool(order), floor), "code int, a long, b long, depth int")
        pairs = pairs.unionByName(blocks).groupBy("code", "a", "b").agg(F.max("depth").alias("depth"))
    return pairs.join(F.broadcast(codes), "code").select("src_table", "a", "b", "depth")  # a row a table


def _sketch_batch(batch) -> dict[str, object]:
    num, den = THRESHOLD
    n_a, n_b = (batch.column(c).to_numpy().astype(np.int32) for c in ("n_a", "n_b"))
    a, spare_a = _unpacked(batch.column("sketch_a").to_pylist(), n_a)
    b, spare_b = _unpacked(batch.column("sketch_b").to_pylist(), n_b)
    common = np.bitwise_count(a & b).sum(axis=1, dtype=np.int32) + np.minimum(spare_a, spare_b)
    keep = np.flatnonzero(common * (num + den) >= num * (n_a + n_b))
    return {c: batch.column(c).take(keep) for c in ("src_table", "a", "b", "depth")}


def by_sketch(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(src_table, a, b, depth) of the pairs that can reach the threshold by their sketches; none that does is left out."""
    side = reps.select("src_table", "row_id", "n", "sketch")
    both = pairs.join(
        side.toDF("src_table", "a", "n_a", "sketch_a"), ["src_table", "a"]
    ).join(side.toDF("src_table", "b", "n_b", "sketch_b"), ["src_table", "b"])
    return map_batches(both, "src_table string, a long, b long, depth int", _sketch_batch)


def depth_reached(counts: dict[tuple[int, int], int], target: float = TARGET_RECALL) -> int:
    """The longest depth whose measured recall reaches the target, else SHORTEST.

    A measure only: no pair is left out by it. counts: pairs by (depth, similarity in SKETCH parts). Each pair that may be similar stands for as many as its
    similarity makes the forest miss at SHORTEST, so the whole is estimated from what was met.
    """
    likely = {k: n for k, n in counts.items() if k[1] >= SKETCH_LIKELY}
    whole = sum(n / (1 - (1 - (agree / SKETCH) ** SHORTEST) ** TREES) for (_, agree), n in likely.items())
    for depth in range(FULL_DEPTH, SHORTEST, -1):
        if whole and sum(n for (at, _), n in likely.items() if at >= depth) >= target * whole:
            return depth
    return SHORTEST


def _verifier(shingle: int):
    def verify(batch) -> dict[str, object]:
        sides = []
        for name in ("text_a", "text_b"):
            texts = [t or "" for t in batch.column(name).to_pylist()]
            known = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            each, parts = list(known), []
            for some in slices(each, SIGN_CHARS):
                grams, counts = core.distinct_per_text(*core.shingles(*core.words(each[some]), shingle))
                parts += np.split(grams, np.cumsum(counts)[:-1])
            sides.append([parts[known[t]] for t in texts])
        common = [core.jaccard_counts(a, b) for a, b in zip(*sides)]
        return {c: batch.column(c) for c in ("src_table", "a", "b")} | {
            "common": [x for x, _ in common],
            "either": [y for _, y in common],
        }

    return verify


def verify(pairs: DataFrame, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(src_table, a, b, common, either) of the pairs whose texts share enough distinct shingles.

    The rows that may be wanted are picked by a broadcast set of bits, then fetched in one join of both
    sides' keys and brought together by pair.
    """
    num, den = THRESHOLD
    ends = pairs.select("src_table", "a", "b", F.explode(F.array("a", "b")).alias("row_id"))
    few = likely_rows(rows.select("src_table", "row_id", "text"), ends, ["src_table", "row_id"])
    texts = ends.join(few, ["src_table", "row_id"])
    both = texts.groupBy("src_table", "a", "b").agg(
        F.max(F.when(F.col("row_id") == F.col("a"), F.col("text"))).alias("text_a"),
        F.max(F.when(F.col("row_id") == F.col("b"), F.col("text"))).alias("text_b"),
    )
    counted = map_batches(
        both, "src_table string, a long, b long, common long, either long", _verifier(shingle)
    )
    return counted.where(F.col("common") * den >= F.col("either") * num)


def representatives(signed: DataFrame, classes: DataFrame, more: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the signed rows that stand for their classes, (src_table, row_id, rep) and `more` of all other rows).

    Only rows of classes of several rows are looked up.
    """
    extra = [more] if more else []
    several = classes.where("n_rows > 1").select(*CLASS, "rep", "n_rows")
    others = join_groups(signed.select(*CLASS, "row_id", *extra), several, CLASS, "n_rows").where("row_id <> rep")
    others = write_table(others.select("src_table", "row_id", "rep", *extra), "near-others")
    return signed.join(others.select("src_table", "row_id"), ["src_table", "row_id"], "left_anti"), others


def class_links(rows: DataFrame, reps: DataFrame, order: str | None = None, floor: int = 0) -> DataFrame:
    """(src_table, a, b, common, either): similar pairs among the signed rows `reps`; a written table.

    rows: (src_table, row_id, text) of at least these rows. All pairs that met are verified, at any depth.
    """
    pairs = write_table(by_sketch(candidate_pairs(reps, order, floor), reps), "near-candidates")
    return write_table(verify(pairs.select("src_table", "a", "b"), rows), "near-links")


def _without_copies(links: DataFrame, signed: DataFrame) -> DataFrame:
    """The links whose two rows are no copies: neither all symbols in order nor all fields agree."""
    side = signed.select("src_table", "row_id", "k1", "k2", "f1", "f2")
    a = side.toDF("src_table", "a", "ka1", "ka2", "fa1", "fa2")
    b = side.toDF("src_table", "b", "kb1", "kb2", "fb1", "fb2")
    same = (F.col("ka1") == F.col("kb1")) & (F.col("ka2") == F.col("kb2"))
    listed = (F.col("fa1") != 0) & (F.col("fa1") == F.col("fb1")) & (F.col("fa2") == F.col("fb2"))
    return (
        links.join(a, ["src_table", "a"])
        .join(b, ["src_table", "b"])
        .where(~(same | listed))
        .select("src_table", "a", "b", "common", "either")
    )


def near_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and (src_table, rep, row_id) of every row of the linked classes."""
    signed = signatures(rows)
    classes = write_table(classes_of(signed), "near-classes")
    links = write_table(_without_copies(class_links(rows, representatives(signed, classes)[0]), signed), "near-pairs")
    linked = links.select("src_table", F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = classes.join(linked, ["src_table", "rep"])
    members = join_groups(signed.select(*CLASS, "row_id"), wanted, CLASS, "n_rows").select("src_table", "rep", "row_id")
    return links, write_table(members, "near-members")


def find_pairs(rows: DataFrame) -> DataFrame:
    """(src_table, row_a, row_b): all pairs of similar rows that are no copies, smaller key first."""
    links, members = near_links(rows)
    left = members.select("src_table", F.col("rep").alias("a"), F.col("row_id").alias("x"))
    right = members.select("src_table", F.col("rep").alias("b"), F.col("row_id").alias("y"))
    return (
        links.join(left, ["src_table", "a"])
        .join(right, ["src_table", "b"])
        .select("src_table", F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
    )


def groups(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, group_id, links): every row with its group's smallest key and its number of similar rows.

    A group holds what is connected by similarity or by equal words; a row alone is its own group.
    """
    signed = signatures(rows)
    classes = write_table(classes_of(signed), "near-classes")
    links = write_table(_without_copies(class_links(rows, representatives(signed, classes)[0]), signed), "near-pairs")
    connected = write_table(connected_components(links, "src_table", "a", "b"), "near-groups").withColumnRenamed("node", "rep")
    sizes = classes.select("src_table", "rep", "n_rows")
    ends = links.select("src_table", F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        links.select("src_table", F.col("b").alias("rep"), F.col("a").alias("other"))
    )
    degree = (
        ends.join(sizes.toDF("src_table", "other", "n"), ["src_table", "other"]).groupBy("src_table", "rep").agg(F.sum("n").alias("links"))
    )
    known = classes.join(connected, ["src_table", "rep"], "left").join(degree, ["src_table", "rep"], "left")
    member = join_groups(signed.select(*CLASS, "row_id"), known.select(*CLASS, "rep", "n_rows", "component", "links"), CLASS, "n_rows")
    found = member.select(
        "src_table", "row_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )
    alone = rows.select("src_table", "row_id").join(signed.select("src_table", "row_id"), ["src_table", "row_id"], "left_anti")
    return found.unionByName(alone.select("src_table", "row_id", F.col("row_id").alias("group_id"), F.lit(0).cast("long").alias("links")))
