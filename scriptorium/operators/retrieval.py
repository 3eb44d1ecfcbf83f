"""Retrieval: scored scans, bounded top-k, hybrid ranking, unions of rankings, batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vector as V

STRONG, FLOOR = 0.55, 0.40
OVER_FETCH = 4


def score(corpus: DataFrame, query: str, embedding: Column) -> DataFrame:
    """The corpus with `score`: one pass of the hybrid score of a literal query.

    corpus: id, document_name, page_number, heading, text and an embedding of the query's length.
    """
    weights = V.embed(query)
    used = [(i, float(w)) for i, w in enumerate(weights) if w]
    dot = sum((F.coalesce(F.get(embedding, i).cast("double"), F.lit(0.0)) * w for i, w in used), F.lit(0.0))
    vector = F.when(F.size(embedding) == V.DIMS, dot).otherwise(0.0)
    columns = (F.col("document_name"), F.col("heading"), F.col("text"))
    return corpus.withColumn("score", V.hybrid_score(vector, V.lexical_score(query, *columns), V.penalties(F.col("text"))))


def rescore(candidates: DataFrame, query: str) -> DataFrame:
    """The second pass: the score so far takes the place of the vector score."""
    columns = (F.col("document_name"), F.col("heading"), F.col("text"))
    return candidates.withColumn(
        "score", V.hybrid_score(F.col("score"), V.lexical_score(query, *columns), V.penalties(F.col("text")))
    )


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best rows; ties by the given columns. Plans as a bounded heap in each task."""
    return scored.orderBy(F.desc("score"), *(ties or ("id",))).limit(k)


def distinct_by_id(ranked: DataFrame, *ties: str) -> DataFrame:
    """One row an id, the best scored."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), *ties)
    return ranked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")


def union_distinct(first: DataFrame, second: DataFrame, *ties: str) -> DataFrame:
    """Both rankings; of rows with one id the first ranking's, then the best scored."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    best = Window.partitionBy("id").orderBy("_p", F.desc("score"), *ties)
    return both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r", "_p")


def promote_siblings(ranked: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k rows shown: below a strong top row first its document's rows, then others from FLOOR on.

    ranked is a candidate list bounded by the over-fetch, so its single window is small by construction.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), *(ties or ("id",)))
    top = ranked.withColumn("_n", F.row_number().over(order)).withColumn("_doc", F.first("document_name").over(order)).withColumn("_max", F.first("score").over(order))
    strong = F.col("_max") >= STRONG
    sibling = F.col("document_name").eqNullSafe(F.col("_doc"))
    kept = top.where(~strong | sibling | (F.col("score") >= FLOOR)).withColumn("_g", F.when(strong & ~sibling, 1).otherwise(0))
    shown = Window.partitionBy(F.lit(0)).orderBy("_g", "_n")
    return kept.withColumn("rank", F.row_number().over(shown)).where(F.col("rank") <= k).drop("_n", "_doc", "_max", "_g")


def search(corpus: DataFrame, query: str, k: int = 5, index: DataFrame | None = None) -> DataFrame:
    """(rank, id, document_name, page_number, heading, text, score, ...): hybrid search with a literal query.

    The scan keeps OVER_FETCH * k rows before rows of one id are united; `index` are candidates of an
    external index, which come first. k below 1 counts as 1.
    """
    k = max(1, k)
    found = top_k(score(corpus, query, F.col("embedding")), OVER_FETCH * k, "id", "row_key").drop("embedding")
    united = union_distinct(index, found, "row_key") if index is not None else distinct_by_id(found, "row_key")
    return promote_siblings(rescore(united, query), k, "id", "row_key")


def nearest_in_blocks(corpus: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, rows: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): for each query vector the k rows with the greatest dot product; ties by id.

    A stated set of queries against all rows: queries are cut into blocks and the corpus into slices,
    both of bounded size; each pair of them is one matrix product that keeps k rows a query. What is
    shuffled after that is k rows a query and slice. corpus: (id, embedding), queries: (query_id,
    embedding); null vectors and those of another length than DIMS are left out.
    """
    good = F.size("embedding") == V.DIMS
    n_blocks = max(1, -(-queries.count() // block))
    n_slices = max(1, -(-corpus.count() // rows))
    left = (
        queries.where(good)
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    )
    right = (
        corpus.where(good)
        .withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("embedding").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, V.DIMS)

    def match(some: pa.Table, other: pa.Table) -> pa.Table:
        if not some.num_rows or not other.num_rows:
            return schema.empty_table()
        ids, keys = some.column("query_id").to_numpy(), other.column("id").to_numpy()
        q, e = matrix(some), matrix(other)
        parts = []
        for at in range(0, len(ids), 256):
            s = np.round(q[at : at + 256] @ e.T, 9)  # equal vectors must tie
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
            i, j = np.nonzero(s >= least[:, None])  # the k best and what ties with the last of them
            order = np.lexsort((keys[j], -s[i, j], i))
            i, j = i[order], j[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            parts.append((ids[at + i[best]], keys[j[best]], s[i[best], j[best]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)

    local = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(match, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def browse(vectors: DataFrame, limit: int = 50) -> DataFrame:
    """Summaries of the first rows of a store; limit <= 0 counts as 50."""
    return (
        vectors.orderBy("vec_row")
        .limit(limit if limit > 0 else 50)
        .select(
            "vec_row", "id", "document_name", "page_number", "heading",
            T.preview(F.col("text"), 180, collapse=False).alias("preview"), F.lit(V.DIMS).alias("dimensions"),
        )
    )
