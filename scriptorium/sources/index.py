"""An external vector index: asked for candidates, and filled anew from the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.predicates import is_usable_vector
from scriptorium.functions.vector import distance_score, embed
from scriptorium.sources.writers import add_to_index

#: What stands for a field that the index doesn't give.
UNKNOWN = {"document": "Unknown", "page": 1, "heading": "General", "distance": 1.0}
RESYNC_BATCH = 50
_ANSWER = "id string, text string, document string, page int, heading string, distance double, sources string, at long"


def candidates(spark: SparkSession, ask: Callable[[list[float], int], list[dict]], query: str, k: int) -> DataFrame | None:
    """The index's answer to a query as candidates for `retrieval.search`, or None where it fails or has none.

    ask: from the query's embedding and k to at most k records with id and text, document, page,
    heading, distance (squared, of unit vectors) and sources as far as it has them. A search without
    candidates scans the store.
    """
    try:
        answer = ask([float(x) for x in embed(query)], k)
    except Exception:  # noqa: BLE001 - whatever the index raises, the scan takes its place
        return None
    rows = [
        (r["id"], r.get("text") or "", *(type(default)(r[c]) if r.get(c) is not None else default for c, default in UNKNOWN.items()), r.get("sources"), i)
        for i, r in enumerate(answer or [])
        if r.get("id") is not None
    ]
    if not rows:
        return None
    found = spark.createDataFrame(rows, _ANSWER)  # k rows at most
    return found.select(
        "id", F.col("at").alias("row_key"), F.col("document").alias("document_name"), F.col("page").alias("page_number"), "heading", "text",
        T.sources_list(F.col("sources"), F.col("document"), F.col("page")).alias("sources"), distance_score(F.col("distance")).alias("score"),
    )


def resync_rows(vectors: DataFrame) -> DataFrame:
    """The rows of a store that fill an index anew: those with id, text and embedding, each with its own source only."""
    usable = vectors.where(is_usable_vector(F.col("id"), F.col("text"), F.col("embedding")))
    label = T.source_label(F.col("document_name"), F.col("page_number"))
    own = F.struct(F.col("document_name").alias("document"), F.col("page_number").alias("page"), "heading", label.alias("sources"))
    return usable.select("id", "document_name", "page_number", "heading", "text", "embedding", own.alias("metadata"))


def resync(vectors: DataFrame, send: Callable[[list[dict]], None], batch: int = RESYNC_BATCH, **how) -> DataFrame:
    """(sent, failed): the store handed to an index as a whole, so that the index covers it; see `add_to_index`."""
    return add_to_index(resync_rows(vectors), send, batch, **how)
