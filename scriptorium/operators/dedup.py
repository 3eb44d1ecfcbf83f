"""Content-addressed deduplication with source citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.predicates import is_usable_vector
from scriptorium.functions.vector import hash_embedding
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

#: The order in which rows of equal content count as seen.
ORDER = ("document_name", "page_number", "chunk_row")


def with_hash(chunks: DataFrame, text: str = "content") -> DataFrame:
    """All columns and `content_hash` and `source`."""
    return chunks.withColumn("content_hash", T.content_hash(F.col(text))).withColumn(
        "source", T.source_label(F.col("document_name"), F.col("page_number"))
    )


def _first(order: tuple[str, ...]) -> Column:
    return F.struct(*(F.coalesce(F.col(c), F.lit("") if c == "document_name" else F.lit(0)).alias(c) for c in order))


def flag_duplicates(chunks: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(chunk_row, content_hash, is_duplicate): every row but the first of its content is a duplicate.

    The texts are read and hashed once. Only contents of several rows are joined back, hot hashes apart,
    so no content gathers in one task, as it would in a window.
    """
    hashed = write_table(with_hash(chunks).select("chunk_row", "content_hash", _first(order).alias("_at")), "hashes")
    firsts = hashed.groupBy("content_hash").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return join_groups(hashed, write_table(firsts, "first-rows"), ["content_hash"], "_n", "left").select(
        "chunk_row", "content_hash", F.coalesce(F.col("_at") != F.col("_first"), F.lit(False)).alias("is_duplicate")
    )


def sources_so_far(hashed: DataFrame) -> DataFrame:
    """(chunk_row, content_hash, sources) of rows (chunk_row, content_hash, source, _at), each with the sources seen up to it.

    Of a content the different sources with their first places are all that is gathered, and only
    where there are several; a row picks those before it.
    """
    pairs = hashed.groupBy("content_hash", "source").agg(F.min("_at").alias("_from"), F.count("*").alias("_c"))
    several = pairs.groupBy("content_hash").agg(F.sum("_c").alias("_n"), F.array_sort(F.collect_list(F.struct("source", "_from"))).alias("_all")).where(F.size("_all") > 1)
    seen = F.transform(F.filter("_all", lambda x: x["_from"] <= F.col("_at")), lambda x: x["source"])
    return join_groups(hashed, write_table(several, "content-sources"), ["content_hash"], "_n", "left").select(
        "chunk_row", "content_hash", F.coalesce(F.array_join(seen, "; "), F.col("source")).alias("sources")
    )


def running_sources(chunks: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(chunk_row, content_hash, sources): for each row the sorted, `; `-joined sources seen up to it."""
    hashed = with_hash(chunks).select("chunk_row", "content_hash", "source", _first(order).alias("_at"))
    return sources_so_far(write_table(hashed, "hashes"))


def roll_up_sources(chunks: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(content_hash, document_name, page_number, heading, copies, sources): one row a content, as first seen."""
    hashed = with_hash(chunks).withColumn("_at", _first(order))
    return (
        hashed.groupBy("content_hash")
        .agg(
            F.min_by(F.struct("document_name", "page_number", "heading"), "_at").alias("f"),
            F.count("*").alias("copies"),
            F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"),
        )
        .select("content_hash", "f.document_name", "f.page_number", "f.heading", "copies", "sources")
    )


def summarise(chunks: DataFrame) -> DataFrame:
    """(files, chunks, indexed, deduplicated): counts of an ingestion."""
    hashed = chunks.select("document_name", T.content_hash(F.col("content")).alias("h"))
    per_hash = hashed.agg(
        F.countDistinct("document_name").alias("files"), F.count("*").alias("chunks"), F.countDistinct("h").alias("indexed")
    )
    return per_hash.withColumn("deduplicated", F.col("chunks") - F.col("indexed"))


def registry(vectors: DataFrame) -> DataFrame:
    """(content_hash, sources, n): the contents of a vector store with all their sources; its usable rows only."""
    usable = vectors.where(is_usable_vector(F.col("id"), F.col("text"), F.col("embedding")))
    listed = usable.select(
        F.col("id").alias("content_hash"),
        F.explode(T.sources_list(F.col("metadata.sources"), F.col("document_name"), F.col("page_number"))).alias("source"),
    )
    return listed.groupBy("content_hash").agg(
        F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"), F.count("*").alias("n")
    )


def against_registry(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_row, content_hash, known): whether a chunk's content is in the vector store already."""
    hashed = chunks.select("chunk_row", T.content_hash(F.col("content")).alias("content_hash"))
    usable = vectors.where(is_usable_vector(F.col("id"), F.col("text"), F.col("embedding")))
    known = usable.select(F.col("id").alias("content_hash")).distinct()
    counts = hashed.groupBy("content_hash").agg(F.count("*").alias("_n")).join(known, "content_hash", "left_semi")
    met = join_groups(hashed, write_table(counts, "known-contents"), ["content_hash"], "_n", "left")
    return met.select("chunk_row", "content_hash", F.col("_n").isNotNull().alias("known"))


def embed_once(chunks: DataFrame) -> DataFrame:
    """(content_hash, embedding): each different content embedded once, however many rows have it."""
    distinct = chunks.select(T.content_hash(F.col("content")).alias("content_hash"), T.text_of(F.col("content")).alias("content"))
    return distinct.groupBy("content_hash").agg(F.min("content").alias("content")).select("content_hash", hash_embedding(F.col("content")).alias("embedding"))
