"""The pN_ queries: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import encoding, format_copies, history, mojibake, near_copies, neighbours, packing, residue, scans, splitting
from scriptorium.llm.frames import text_rows
from scriptorium.session import table, write_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.find_copies(text_rows(spark, sf_dir))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.collapse(text_rows(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(text_rows(spark, sf_dir))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.keep_content(text_rows(spark, sf_dir)).select("src_table", "row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.find_pairs(table(spark, sf_dir, "vector_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.find_pairs(text_rows(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.groups(text_rows(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "rag_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where(F.col("piece_no") == 0).select("chunk_row")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.find_repeats(*(table(spark, sf_dir, name) for name in ("rag_chunks", "document_jobs", "pipeline_runs")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(scans.titled_rows(spark, sf_dir)).select("src_table", "row_id")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(scans.titled_rows(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_column(table(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = write_table(encoding.count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    return packing.pack(sizes)


def p9_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unused(p9_packed(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_words(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_records": p1_records,
        "p2_found": p2_found,
        "p2_kept": p2_kept,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_repaired": p7_repaired,
        "p8_ids": p8_ids,
        "p9_packed": p9_packed,
        "p9_unused": p9_unused,
        "p10_found": p10_found,
        "p10_restored": p10_restored,
    }
