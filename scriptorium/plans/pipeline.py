"""The whole way: pages to chunks to vectors, search, answers, and reports on a run."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T
from scriptorium.functions.vector import hash_embedding
from scriptorium.operators import chunking, dedup, ledger, metrics, relevance, retrieval, structure, synthesis
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table
from scriptorium.sources import index, readers


def parse(pages: DataFrame) -> DataFrame:
    """Pages (document_name, page_number, page_text) to staged documents (document_name, text)."""
    return structure.stage_documents(pages)


def chunk(documents: DataFrame) -> DataFrame:
    """Staged documents to chunks."""
    return chunking.chunk_documents(documents)


def vectorize(chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Chunks (with chunk_row) to vector rows: content hash, embedding of each different content, sources so far.

    stored: the vector rows of earlier runs. A content that is stored already is a duplicate from its
    first row on, takes the embedding over, and its sources begin with the stored ones. Texts are hashed
    once; only first rows of new contents are embedded, all others look their embedding up.
    """
    order = dedup._first(dedup.ORDER)
    rows = write_table(
        dedup.with_hash(chunks).select(
            "chunk_row", "content_hash", "source", order.alias("_at"), "document_name", "page_number", "heading", T.text_of(F.col("content")).alias("text")
        ),
        "hashed-chunks",
    )
    facts = rows.groupBy("content_hash").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    if stored is not None:
        usable = stored.where(P.is_usable_vector(F.col("id"), F.col("text"), F.col("embedding")))
        known = usable.groupBy(F.col("id").alias("content_hash")).agg(F.min_by("embedding", F.struct("vec_row")).alias("_stored"))
        known = known.join(dedup.registry(stored).select("content_hash", F.col("sources").alias("_listed")), "content_hash")
        facts = facts.join(known, "content_hash", "left")
    else:
        facts = facts.select("*", F.lit(None).cast("array<float>").alias("_stored"), F.lit(None).cast("string").alias("_listed"))
    facts = write_table(facts.where("_n > 1 or _stored is not null"), "content-facts")
    judged = join_groups(rows, facts, ["content_hash"], "_n", "left")
    fresh = F.coalesce((F.col("_at") == F.col("_first")) & F.col("_stored").isNull(), F.lit(True))
    new = judged.where(fresh).withColumn("embedding", hash_embedding(F.col("text")))
    new = write_table(new.withColumn("deduplicated", F.lit(False)), "new-vectors")
    again = judged.where(~fresh).drop("_n")
    first = new.where("_n > 1").select("content_hash", F.col("_n"), F.col("embedding").alias("_new"))
    again = join_groups(again, first, ["content_hash"], "_n", "left").withColumn("embedding", F.coalesce("_stored", "_new")).drop("_new")
    both = new.unionByName(again.withColumn("deduplicated", F.lit(True)))
    sources = dedup.sources_so_far(rows).select("chunk_row", F.col("sources").alias("_seen"))
    listed = F.array_join(F.array_sort(F.array_union(F.split("_listed", "; "), F.split("_seen", "; "))), "; ")
    out = both.join(sources, "chunk_row").withColumn("sources", F.coalesce(listed, F.col("_seen")))
    return out.select(
        F.col("chunk_row").alias("vec_row"), F.col("content_hash").alias("id"), "document_name", "page_number", "heading", "text", "embedding",
        F.struct(F.col("document_name").alias("document"), F.col("page_number").alias("page"), "heading", "sources", "deduplicated").alias("metadata"),
    )


def corpus_of_chunks(chunks: DataFrame) -> DataFrame:
    """A searchable corpus straight from chunks: each row with the embedding of its content."""
    return chunks.select(
        T.content_hash(F.col("content")).alias("id"), F.col("chunk_row").alias("row_key"), "document_name", "page_number", "heading",
        T.text_of(F.col("content")).alias("text"),
        F.array(T.source_label(F.col("document_name"), F.col("page_number"))).alias("sources"),
        hash_embedding(F.col("content")).alias("embedding"),
    )


def corpus_of_vectors(vectors: DataFrame) -> DataFrame:
    """A searchable corpus from stored vectors; rows without an embedding can't be found."""
    return vectors.where(F.col("embedding").isNotNull()).select(
        "id", F.col("vec_row").alias("row_key"), "document_name", "page_number", "heading", T.text_of(F.col("text")).alias("text"),
        T.sources_list(F.col("metadata.sources"), F.col("document_name"), F.col("page_number")).alias("sources"), "embedding",
    )


def ingest(
    pages: DataFrame, done: DataFrame | None = None, stored: DataFrame | None = None, staged: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages to (staged documents, chunks, vectors).

    done: a ledger; documents whose checksum (a column of the pages) a completed job has are left out,
    whatever their name, if their staged output is still among `staged` (document_name) where that is
    given. Resuming is ingesting with the ledger. stored: the vector rows of earlier runs, see `vectorize`.
    """
    if done is not None:
        if "checksum" not in pages.columns:
            raise ValueError("pages need a checksum to be matched with the ledger")
        finished = done.where(ledger.is_completed(done)).select("checksum", T.base_name(F.col("filename")).alias("_name"))
        if staged is not None:
            finished = finished.join(staged.select(F.col("document_name").alias("_name")).distinct(), "_name", "left_semi")
        pages = pages.join(finished.select("checksum").distinct(), "checksum", "left_anti")
    documents = parse(pages)
    chunks = chunk(documents).withColumn("chunk_row", F.xxhash64("chunk_id"))
    return documents, chunks, vectorize(chunks, stored)


def ingest_stream(spark: SparkSession, folder: str, extract, sink, checkpoint: str, done=None, stored=None):
    """A running query over a landing folder: each micro-batch of files is parsed, chunked and embedded, then given to `sink`.

    extract: bytes to page texts; sink(documents, chunks, vectors, batch number); done and stored: calls
    that give the ledger and the vector rows so far, asked once a batch.
    """

    def one(files: DataFrame, number: int) -> None:
        files = files.withColumn("checksum", T.file_checksum(F.col("content")))
        pages, _ = readers.read_pages(files, extract)
        name = T.base_name(F.element_at(F.split("path", "/"), -1))
        pages = pages.join(files.select(name.alias("document_name"), "checksum"), "document_name")
        sink(*ingest(pages, done() if done else None, stored() if stored else None), number)

    stream = readers.landing_stream(spark, folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search(corpus: DataFrame, query: str, k: int = 5, ask_index: Callable[[list[float], int], list[dict]] | None = None) -> DataFrame:
    """Hybrid search; ask_index: an external index whose candidates come first, see `sources.index.candidates`."""
    found = index.candidates(corpus.sparkSession, ask_index, query, retrieval.OVER_FETCH * max(1, k)) if ask_index else None
    return retrieval.search(corpus, query, k, found)


def relevant(corpus: DataFrame, query: str, k: int = 5, query_id: int = 0) -> DataFrame:
    """The filtered results an answer is made of."""
    k = max(1, min(20, k))
    found = retrieval.search(corpus, query, 3 * max(k, 5)).withColumn("query_id", F.lit(query_id)).withColumn("query", F.lit(query))
    return relevance.cut(relevance.filter_results(found, relevance.ASK_THRESHOLD), k)


NO_CONTEXT = "No relevant document context found in the vector index for your query. Please ingest documents first."


def prompts(results: DataFrame) -> DataFrame:
    """(query_id, query, prompt): the prompt of a language model for each query's filtered results."""
    lines = relevance.citations(results).select("query_id", "rank", "context").join(results.select("query_id", "rank", "query"), ["query_id", "rank"])
    whole = lines.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "context"))).alias("c"))
    return whole.select("query_id", "query", T.prompt(F.array_join(F.transform("c", lambda x: x["context"]), ""), F.col("query")).alias("prompt"))


def answered_by(results: DataFrame, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(query_id, told): what a language model answers to the prompts; null where it fails or is silent."""

    @F.pandas_udf("string")
    def run(asked: pd.Series) -> pd.Series:
        try:
            told = model(asked.tolist())
        except Exception:  # noqa: BLE001 - whatever the model raises, the extractive answer takes its place
            told = [None] * len(asked)
        return pd.Series([t if t and t.strip() else None for t in told], dtype=object)

    return prompts(results).select("query_id", run("prompt").alias("told"))


def ask(corpus: DataFrame, query: str, k: int = 5, model: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """(query, answer, citations, total_context_chunks): small talk at once, else an answer with citations.

    model: a language model, from prompts to answers, that the executors call; without one, or where it
    fails, the answer is extracted from the results.
    """
    spark = corpus.sparkSession
    one = spark.range(1).select(T.normalise_query(F.lit(query)).alias("query"))
    talk = one.where(P.is_conversational(F.col("query"))).select("query", T.small_talk_reply(F.col("query")).alias("answer"))
    results = relevant(corpus, query, k)
    cited = relevance.citations(results).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document", "page", "heading", "score", "preview"))).alias("citations")
    )
    answered = synthesis.answers(results).join(cited, "query_id")
    if model is not None:
        answered = answered.join(answered_by(results, model), "query_id", "left").withColumn("answer", F.coalesce("told", "answer"))
    return (
        one.join(talk.select(F.col("query").alias("_q"), F.col("answer").alias("_talk")), F.col("query") == F.col("_q"), "left")
        .join(answered.select("answer", "citations").limit(1), F.lit(True), "left")
        .select(
            "query",
            F.coalesce("_talk", "answer", F.lit(NO_CONTEXT)).alias("answer"),
            F.when(F.col("_talk").isNull(), F.col("citations")).alias("citations"),
            F.when(F.col("_talk").isNull() & F.col("citations").isNotNull(), F.size("citations")).otherwise(0).alias("total_context_chunks"),
        )
    )


def store_status(vectors: DataFrame) -> DataFrame:
    """(vectors, contents, documents) of a vector store."""
    return vectors.agg(F.count("*").alias("vectors"), F.countDistinct("id").alias("contents"), F.countDistinct("document_name").alias("documents"))


def query_metrics(log: DataFrame) -> DataFrame:
    """One row of request counters and latencies."""
    counts = metrics.outcome(log).agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "SUCCESS").alias("succeeded"))
    return counts.join(metrics.percentiles(log)).join(metrics.first_token(log).select("mean_first_token_ms"))


def run_report(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(discovered, processed, failed, pages, ..., files, chunks, indexed, deduplicated) of a run."""
    return ledger.parse_summary(jobs).join(dedup.summarise(chunks))
