"""Problem 3: the most similar vectors of every vector.

Vectors of length one are projected by several independent Gaussian (2-stable) maps to DIMS
dimensions. Each projection is indexed by a kd-tree: its upper levels are fitted on a bounded sample
and route every vector to a cell; within a cell the tree goes on with exact medians down to leaves.

A leaf is searched incrementally: of each row the FIRST projected neighbours are verified, then those
that follow, until the stopping test holds. A squared projected distance divided by the squared true
distance follows a chi-square law with DIMS degrees of freedom, so a row stops where its next projected
neighbour is farther than one as near as its k-th best would be projected with probability
1 - MISS_PROBABILITY; a row without k good neighbours stops where that holds for a pair at `least`. Projections are as many as make a pair at `least` itself share a
leaf with the target probability, whatever the number of rows; none is left out (`trees_needed`).
Verified neighbours are merged over the projections, exact cosines decide.

A single tree searched across its cells would have to visit most of them: at a cosine of 0.9 the
chi-square radius in 8 dimensions is 1.9 where the data spread is 1 in each. Hence several trees.
`exact_neighbours` compares a stated set of queries with all rows in blocks where that is wanted.

Usable rows have an embedding of DIM elements that aren't all zero, without null or non-finite ones,
and aren't marked as deduplicated; all others, null embeddings among them, are left out. Rows with equal
embeddings form a class of which one row is searched; ties are broken by the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.frames import map_batches
from scriptorium.operators.retrieval import nearest_in_blocks
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

DIM = 128
DIMS = 8
K = 5
LEAF = 1024
SAMPLE = 50_000  # rows the upper tree levels are fitted on, at most; every row is indexed
MOST_CELLS = 4096
MISS_PROBABILITY = 0.002
TARGET = 0.99  # for a pair at LEAST itself; more similar ones meet more surely
LEAST = 0.9
FIRST = 32  # projected neighbours of a row verified at first
CODE_ERROR = 0.01  # cosines of 8-bit codes are off by less


def chi_square_quantile(p: float, dims: int) -> float:
    """The p-quantile of the chi-square law, by bisection of the regularised incomplete gamma series."""

    def cdf(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > 1e-15 * total:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, dims + 20 * math.sqrt(2 * dims) + 50
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def projection(tree: int, dim: int = DIM) -> np.ndarray:
    """The Gaussian map of a tree."""
    return np.random.default_rng(1000 + tree).standard_normal((dim, DIMS)).astype(np.float32)


def trees_needed(n_rows: int, cosine: float = LEAST, target: float = TARGET, leaf: int = LEAF) -> int:
    """How many trees make a pair of this cosine share a leaf in one of them with the target probability.

    A median split separates the pair with about E|d| times the density at the median, where d is
    its projected difference.
    """
    levels = max(0, math.ceil(math.log2(max(1, n_rows / leaf))))
    apart = math.sqrt(2 * (1 - cosine)) * math.sqrt(2 / math.pi) / math.sqrt(2 * math.pi)
    together = (1 - apart) ** levels
    return 1 if together >= target else math.ceil(math.log(1 - target) / math.log(1 - together))


def fit_cells(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and value of each inner node of a complete kd-tree, in heap order."""
    dims, values = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1, np.float32)
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, own = stack.pop()
        if node >= len(dims):
            continue
        part = points[own]
        d = int(np.argmax(part.var(axis=0))) if len(own) else 0
        v = np.median(part[:, d]) if len(own) else 0.0
        dims[node], values[node] = d, v
        right = part[:, d] > v
        stack += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
    return dims, values


def cells_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range(int(math.log2(len(dims) + 1))):
        node = 2 * node + 1 + (points[rows, dims[node]] > values[node])
    return node - len(dims)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_row, embedding) of the rows that take part."""
    e = F.col("embedding")
    return vectors.where(
        ~F.coalesce(F.col("metadata.deduplicated"), F.lit(True))
        & (F.size(e) == DIM)
        & F.exists(e, lambda x: x != 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("vec_row", "embedding")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(unit: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of unit[rows[i]] and unit[j]; one matrix product where the pairs are many."""
    if i.size > 0.05 * len(rows) * len(unit):
        return (unit[rows] @ unit.T)[i, j]
    parts = [np.einsum("ij,ij->i", unit[rows[i[s : s + 20000]]], unit[j[s : s + 20000]]) for s in range(0, i.size, 20000)]
    return np.concatenate(parts) if parts else np.zeros(0, unit.dtype)


def search_incrementally(unit: np.ndarray, low: np.ndarray, quantile: float, least: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of the verified neighbours of each row of a leaf, and the stopping test above.

    unit: rows of length one; low: their projections; quantile: of the chi-square law. Of each row the
    FIRST nearest by projected distance are verified; where the next one may still be as near as the
    k-th best so far, so are all those for which that holds, and no others.
    """
    n = len(unit)
    square = (low * low).sum(axis=1)
    limit = 2 * (1 - least) * quantile  # of a pair at `least`
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        far = square[rows, None] + square[None, :] - 2 * (low[rows] @ low.T)
        far[np.arange(len(rows)), rows] = np.inf
        near = far <= limit
        more = np.flatnonzero(near.sum(axis=1) > FIRST)  # all others verify what is near and are done
        if more.size:
            order = np.argpartition(far[more], FIRST - 1, axis=1)[:, :FIRST]
            cosine = _cosines(unit, rows, np.repeat(more, FIRST), order.ravel()).reshape(order.shape)
            kth = np.maximum(np.partition(cosine, FIRST - keep, axis=1)[:, FIRST - keep], least)
            near[more] = far[more] <= np.minimum(limit, 2 * (1 - kth + CODE_ERROR) * quantile)[:, None]
            near[more[:, None], order] = True
        i, j = np.nonzero(near)
        cosine = _cosines(unit, rows, i, j)
        good = cosine >= least
        out.append((rows[i[good]], j[good], cosine[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _search_leaf(ids: np.ndarray, unit: np.ndarray, low: np.ndarray, quantile: float, least: float, keep: int, leaf: int) -> Iterator[tuple]:
    """(a, b, cosine) of verified neighbours within each leaf: all that may be among the `keep` best by the coding error."""
    if len(ids) > leaf:
        d = int(np.argmax(low.var(axis=0)))
        order = np.argsort(low[:, d], kind="stable")
        for part in (order[: len(ids) // 2], order[len(ids) // 2 :]):
            yield from _search_leaf(ids[part], unit[part], low[part], quantile, least, keep, leaf)
        return
    a, b, cosine = search_incrementally(unit, low, quantile, least, keep)
    if not a.size:
        return
    order = np.lexsort((ids[b], -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    first = np.searchsorted(a, a, side="left")
    last = np.minimum(first + keep, np.searchsorted(a, a, side="right")) - 1
    top = cosine >= cosine[last] - 2 * CODE_ERROR
    yield ids[a[top]], ids[b[top]], cosine[top]


def find_neighbours(rows: DataFrame, k: int = K, least: float = LEAST, n_rows: int | None = None, leaf: int = LEAF) -> DataFrame:
    """(a, b, cosine): up to `k` most similar other rows of each row of (vec_row, embedding), from `least` on.

    The rows should have different embeddings (see `find_pairs` for classes of equal ones).
    """
    spark = rows.sparkSession
    n_rows = rows.count() if n_rows is None else n_rows
    schema_out = "a long, b long"
    if n_rows < 2:
        return spark.createDataFrame([], "a long, b long, cosine double")
    trees = trees_needed(n_rows, least, leaf=leaf)
    levels = min(int(math.log2(MOST_CELLS)), max(0, round(math.log2(max(1, n_rows / (4 * leaf))))))
    share = min(1.0, SAMPLE / n_rows)
    sample = rows.where(F.pmod(F.xxhash64("vec_row"), F.lit(1 << 20)) < int(share * (1 << 20))).select("embedding")
    fitted_on = _unit(_matrix(sample.limit(2 * SAMPLE).toArrow().column("embedding")))
    maps = [projection(t) for t in range(trees)]
    cells = [fit_cells(fitted_on @ m, levels) for m in maps] if levels else [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * trees
    shared = spark.sparkContext.broadcast(cells)  # MOST_CELLS nodes a tree, 48 kB
    quantile = chi_square_quantile(1 - MISS_PROBABILITY, DIMS)
    rough = least - CODE_ERROR

    def route(batch: pa.RecordBatch) -> dict[str, object]:
        unit = _unit(_matrix(batch.column("embedding")))
        scale = np.abs(unit).max(axis=1, keepdims=True)
        codes = np.rint(unit / scale * 127).astype(np.int8)
        blobs = [c.tobytes() for c in codes]
        own = [cells_of(unit @ m, *c) + t * MOST_CELLS for t, (m, c) in enumerate(zip(maps, shared.value))]
        return {
            "cell": np.concatenate(own).astype(np.int32),
            "vec_row": pa.concat_arrays([batch.column("vec_row")] * trees),
            "code": blobs * trees,
        }

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(cell: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([p.column("vec_row").to_numpy() for p in parts])
            codes = np.frombuffer(b"".join(x for p in parts for x in p.column("code").to_pylist()), np.int8)
            unit = _unit(codes.reshape(-1, DIM).astype(np.float32))
            for a, b, _ in _search_leaf(ids, unit, unit @ maps[cell // MOST_CELLS], quantile, rough, k, leaf):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        current, held = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(cell)]):
                if begin == end:
                    continue
                if cell[begin] != current:
                    if held:
                        yield from flush(current, held)
                    current, held = int(cell[begin]), []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from flush(current, held)

    routed = map_batches(rows, "cell int, vec_row long, code binary", route)
    pairs = routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, schema_out)
    near = write_table(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neighbour-candidates"
    )

    def cosines(batch: pa.RecordBatch) -> dict[str, object]:
        x = _unit(_matrix(batch.column("ea")).astype(np.float64))
        y = _unit(_matrix(batch.column("eb")).astype(np.float64))
        return {"a": batch.column("a"), "b": batch.column("b"), "cosine": np.einsum("ij,ij->i", x, y)}

    exact = map_batches(
        near.join(rows.toDF("a", "ea"), "a").join(rows.toDF("b", "eb"), "b"), "a long, b long, cosine double", cosines
    ).where(F.col("cosine") >= least)
    exact = write_table(exact, "neighbour-cosines")
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("a", "b", "cosine")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, id, score, rank): the k most similar usable rows of each query (query_id, embedding), by brute force in blocks.

    Costs the product of both numbers of rows: for a stated set of queries, as in measuring recall.
    """
    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(e, lambda x: x / norm).alias("embedding")
    return nearest_in_blocks(usable_rows(vectors).select(F.col("vec_row").alias("id"), unit), queries.select("query_id", unit), k)


def equal_classes(usable: DataFrame) -> DataFrame:
    """(vec_row, rep, n): rows by equal embedding, with the class's smallest key and size."""
    hashed = usable.select(
        "vec_row",
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit(7), "embedding").alias("h2"),
    )
    hashed = write_table(hashed, "embedding-hashes")
    sizes = hashed.groupBy("h1", "h2").agg(F.min("vec_row").alias("rep"), F.count("*").alias("n"))
    return join_groups(hashed, sizes, ["h1", "h2"], "n").select("vec_row", "rep", "n")


def find_pairs(vectors: DataFrame, k: int = K, least: float = LEAST, leaf: int = LEAF) -> DataFrame:
    """(vec_a, vec_b): pairs of usable rows with a cosine of at least `least`, one among the k most similar of the other."""
    usable = usable_rows(vectors)
    classes = write_table(equal_classes(usable), "embedding-classes")
    reps = write_table(
        usable.join(classes.where(F.col("vec_row") == F.col("rep")).select("vec_row"), "vec_row"), "embedding-reps"
    )
    near = write_table(find_neighbours(reps, k, least, leaf=leaf), "neighbour-lists")
    # The k + 1 smallest keys of each class are all that any row's list can need of it.
    leading = write_table(_leading(classes, k + 1), "embedding-leading")
    several = classes.where(F.col("n") > 1).select(F.col("vec_row").alias("a"), "rep")
    own = join_groups(several, leading, ["rep"], "n").select("a", F.explode("first").alias("b"), F.lit(1.0).alias("cosine")).where("a <> b")
    # a class's rows share one list; a class of more than k rows is its own list and needs no other
    lists = near.join(leading.select(F.col("rep").alias("b"), "first"), "b", "left").select(
        F.col("a").alias("rep"), "cosine", F.explode(F.coalesce("first", F.array("b"))).alias("b")
    )
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "b")
    lists = lists.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    lists = lists.join(classes.where("vec_row = rep").select("rep", "n"), "rep").where((F.col("n") <= k) | (F.col("cosine") > 1 - 1e-9))
    lists = lists.groupBy("rep", "n").agg(F.collect_list(F.struct("b", "cosine")).alias("others"))
    other = join_groups(classes.select(F.col("vec_row").alias("a"), "rep"), lists, ["rep"], "n").select("a", F.explode("others").alias("o")).select("a", "o.b", "o.cosine")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    top = own.unionByName(other).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return top.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def _leading(classes: DataFrame, count: int) -> DataFrame:
    """(rep, first, n): the smallest `count` keys of each class of several rows, found within salts first."""
    several = classes.where(F.col("n") > 1).withColumn("salt", F.pmod(F.xxhash64("vec_row"), F.lit(64)))
    inner = Window.partitionBy("rep", "salt").orderBy("vec_row")
    few = several.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= count)
    return few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("vec_row")), 1, count).alias("first"), F.max("n").alias("n"))
