"""Relevance filtering of ranked results: quality predicates, thresholds, relative cut-off, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T

DEFAULT_THRESHOLD, ASK_THRESHOLD = 0.28, 0.25
STRONG, RELATIVE, LEAST = 0.65, 0.70, 0.40


def passes(document: Column, raw: Column, clean: Column, query: Column) -> Column:
    """Whether a result is content at all: no preamble, cover page, curriculum vitae or code dump."""
    return ~(
        P.is_boilerplate(raw) | T.is_blank(clean) | P.is_cover_page(clean) | P.is_resume(document, clean, query) | P.is_code_dump(clean, query)
    )


def filter_results(results: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The results (query_id, query, rank, document_name, text, score, ...) that stay, with cleaned texts.

    Of each query the content rows from the threshold on; with a strong best row only those near it;
    if nothing stays, the first content row whatever its score. A threshold of 0 or less counts as the
    default. Results of a query are bounded by its top-k, so windows over a query are small.
    """
    threshold = threshold if threshold > 0 else DEFAULT_THRESHOLD
    clean = results.withColumn("_raw", F.col("text")).withColumn("text", T.clean_content(F.col("text")))
    content = clean.where(passes(F.col("document_name"), F.col("_raw"), F.col("text"), F.col("query"))).drop("_raw")
    within = Window.partitionBy("query_id")
    good = F.col("score") >= threshold
    judged = (
        content.withColumn("_best", F.max(F.when(good, F.col("score"))).over(within))
        .withColumn("_first", F.min("rank").over(within))
        .withColumn("_cut", F.when(F.col("_best") >= STRONG, F.greatest(F.lit(LEAST), F.col("_best") * RELATIVE)).otherwise(threshold))
    )
    kept = (good & (F.col("score") >= F.col("_cut"))) | (F.col("_best").isNull() & (F.col("rank") == F.col("_first")))
    return judged.where(kept).drop("_best", "_first", "_cut")


def cut(results: DataFrame, k: int) -> DataFrame:
    """The first max(k, 5) results of each query, renumbered."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 5))


def citations(results: DataFrame) -> DataFrame:
    """(query_id, rank, document, page, heading, score, preview, context): the citations of an answer."""
    label = T.citation_label(F.col("document_name"), F.col("sources"))
    return results.select(
        "query_id",
        "rank",
        label.alias("document"),
        F.col("page_number").alias("page"),
        "heading",
        "score",
        T.preview(F.col("text")).alias("preview"),
        T.context_line(F.col("rank"), label, F.col("page_number"), F.col("heading"), F.col("text")).alias("context"),
    )


def token_groups(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, group_no, token): an answer's words as they are streamed, the first alone, then three at a time.

    Every word is followed by a blank; an empty answer is one empty word.
    """
    words = answers.select(key, F.posexplode(F.split(T.text_of(F.col(answer)), " ")).alias("at", "word"))
    group = F.ceil(F.col("at") / 3).cast("int")
    return (
        words.groupBy(key, group.alias("group_no"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select(key, "group_no", F.concat(F.array_join(F.transform("w", lambda x: x["word"]), " "), F.lit(" ")).alias("token"))
    )
