"""All queries of the core, by name, and the SQL that gives the same rows.

Every query runs over whole tables. Where no SQL is given the operator is a sequential fold or text
synthesis; these are tested against plain versions on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T
from scriptorium.functions import vector as V
from scriptorium.operators import chunking, dedup, guards, ledger, metrics, relevance, retrieval, structure, synthesis
from scriptorium.plans import pipeline
from scriptorium.plans.oracle import NOTHING, PHRASE, SECOND, oracle_sql
from scriptorium.session import table, table_path
from scriptorium.sources import index, readers, writers

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks")


@_query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row", T.content_hash(F.col("content")).alias("content_hash"))


@_query
def dedup_flags(spark: SparkSession, d: str) -> DataFrame:
    return dedup.flag_duplicates(_chunks(spark, d))


@_query
def running_sources(spark: SparkSession, d: str) -> DataFrame:
    return dedup.running_sources(_chunks(spark, d))


@_query
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.roll_up_sources(_chunks(spark, d))


@_query
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.summarise(_chunks(spark, d))


@_query
def vector_registry(spark: SparkSession, d: str) -> DataFrame:
    return dedup.registry(table(spark, d, "vector_documents")).drop("n")


@_query
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    return dedup.against_registry(_chunks(spark, d), table(spark, d, "vector_documents"))


@_query
def term_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = _chunks(spark, d).select("chunk_row", F.posexplode(V.term_histogram(F.col("content"))).alias("bucket", "n"))
    return counts.where(F.col("n") > 0).select("chunk_row", "bucket", F.col("n").cast("long").alias("n"))


@_query
def resync_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = index.resync_rows(table(spark, d, "vector_documents"))
    return rows.groupBy("id", "document_name", "page_number", "metadata.sources").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).cast("long").alias("numbers"))


@_query
def embed_once(spark: SparkSession, d: str) -> DataFrame:
    embedded = dedup.embed_once(_chunks(spark, d))
    weights = embedded.select("content_hash", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0")
    return weights.select("content_hash", "bucket", F.round(F.col("x").cast("double"), 3).alias("weight"))


@_query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    probe = vectors.where(F.col("vec_id") == 0).select(F.col("embedding").alias("probe"))  # one row: vec_id is unique
    scored = vectors.join(F.broadcast(probe)).select("vec_id", F.round(V.similarity(F.col("embedding"), F.col("probe")), 6).alias("cosine"))
    ranked = scored.orderBy(F.desc("cosine"), "vec_id").limit(10)
    return ranked.withColumn("score", F.round(V.distance_score(2 - 2 * F.col("cosine")), 6))


@_query
def lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    lexical = V.lexical_score(PHRASE, F.col("document_name"), F.col("heading"), F.col("content"))
    return _chunks(spark, d).select("chunk_row", F.round(lexical, 6).alias("lexical"), V.penalties(F.col("content")).alias("rules"))


def _found(spark: SparkSession, d: str, query: str, k: int) -> DataFrame:
    return pipeline.search(pipeline.corpus_of_chunks(_chunks(spark, d)), query, k)


@_query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, PHRASE, 5).select("rank", "id", "document_name", "page_number", F.round("score", 5).alias("score"))


@_query
def sibling_promotion(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, SECOND, 20).select("rank", "id", "document_name", F.round("score", 5).alias("score"))


@_query
def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    corpus = pipeline.corpus_of_chunks(_chunks(spark, d)).select("id", "row_key", "document_name", "page_number", "heading", "text", "embedding")
    first, second = (retrieval.top_k(retrieval.score(corpus, q, F.col("embedding")), 40, "id", "row_key") for q in (PHRASE, SECOND))
    return retrieval.union_distinct(first, second, "row_key").select("id", "row_key", F.round("score", 5).alias("score"))


@_query
def batch_retrieval(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "vector_documents")
    asked = vectors.where(F.col("vec_row") % 100 == 0).select(F.col("vec_row").alias("query_id"), "embedding")
    found = retrieval.nearest_in_blocks(vectors.select(F.col("vec_row").alias("id"), "embedding"), asked, 5)
    return found.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@_query
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    return structure.classify_lines(_chunks(spark, d), "chunk_row", "content")


@_query
def table_islands(spark: SparkSession, d: str) -> DataFrame:
    return structure.tables(structure.classify_lines(_chunks(spark, d), "chunk_row", "content"), "chunk_row")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several pages: the passages between blank lines."""
    pieces = F.posexplode(F.split(T.text_of(F.col("text")), "\n\n")).alias("at", "page_text")
    named = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_name"), pieces)
    return named.select("document_name", (F.col("at") + 1).alias("page_number"), "page_text")


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """The same pages as staged texts, their lines as they are."""
    name, pieces = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.split(T.text_of(F.col("text")), "\n\n")
    marked = F.transform(pieces, lambda x, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), x))
    return table(spark, d, "documents").select(
        name.alias("document_name"), F.concat(structure.preamble(name, F.size(pieces)), F.array_join(marked, "\n\n")).alias("text")
    )


@_query
def page_heading_carry(spark: SparkSession, d: str) -> DataFrame:
    carried = structure.carry_page_and_heading(_staged(spark, d), "document_name", "text")
    return carried.select("document_name", "line_no", "page", "heading")


@_query
def staged_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.parse(_pages(spark, d))


@_query
def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    """Written as files and read back."""
    folder = table_path(spark, "staged")
    writers.write_markdown(_staged(spark, d), folder)
    return readers.read_staged(spark, folder)


@_query
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The staged files as a source of files: names, lengths, checksums, how they would be read."""
    folder = table_path(spark, "staged")
    writers.write_markdown(_staged(spark, d), folder)
    plans = readers.inspect_files(spark, folder, "md").select("path", "megabytes", "strategy")
    return readers.scan_files(spark, folder, "MD").join(plans, "path").select("file_name", "length", "checksum", "megabytes", "strategy")


@_query
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read back."""
    path = table_path(spark, "chunk-lines")
    writers.write_chunks(_chunks(spark, d), path)
    return readers.read_chunks(spark, path, "*.json")[0].groupBy("chunk_id", "document_name", "page_number", "heading", "content", "character_count").agg(F.count("*").alias("n"))


@_query
def vector_lines(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON lines and read back, and the number of lines of the store."""
    path = table_path(spark, "vector-lines")
    writers.write_vectors(table(spark, d, "vector_documents"), path)
    back = readers.read_vectors(spark, path, "*.json")
    return back.groupBy("id").agg(
        F.count("*").alias("n"), F.sum(F.size("embedding")).cast("long").alias("numbers"), F.count_if("metadata.deduplicated").alias("duplicates"),
        F.max("metadata.sources").alias("sources"), F.lit(readers.count_lines(spark, path, "*.json")).cast("long").alias("lines"),
    )


@_query
def index_batches(spark: SparkSession, d: str) -> DataFrame:
    """What an index that takes every batch is sent."""
    return writers.add_to_index(table(spark, d, "vector_documents").select("id", "embedding"), lambda rows: None)


@_query
def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_staged(spark, d))


@_query
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_summary(chunking.chunk_documents(_staged(spark, d)))


@_query
def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = pipeline.vectorize(_chunks(spark, d))
    used = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_row", "id", "metadata.sources", "metadata.deduplicated", F.size("embedding").alias("dimensions"), F.round(used, 3).alias("squares"))


@_query
def vector_rows_again(spark: SparkSession, d: str) -> DataFrame:
    """The runs from 7 on against the vectors of all others."""
    runs = table(spark, d, "pipeline_runs").select("pipeline_run_id", "run_no")
    chunks = _chunks(spark, d).join(F.broadcast(runs), "pipeline_run_id", "left")  # a row a run
    late = F.coalesce(F.col("run_no") >= 7, F.lit(False))
    stored = pipeline.vectorize(chunks.where(~late))
    return pipeline.vectorize(chunks.where(late), stored).select("vec_row", "id", "metadata.sources", "metadata.deduplicated", F.size("embedding").alias("dimensions"))


@_query
def clean_content(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row", T.clean_content(F.col("content")).alias("clean"))


@_query
def strip_outline(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row", T.strip_outline(F.col("content")).alias("stripped"))


@_query
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row", F.posexplode(synthesis.paragraphs_of(F.col("content"))).alias("paragraph_no", "paragraph"))


@_query
def salient_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row", F.posexplode(synthesis.salient(F.col("content"), PHRASE)).alias("sentence_no", "sentence"))


@_query
def term_definitions(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.definitions_of(_chunks(spark, d), "chunk_row", "content")


@_query
def small_talk(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_text")
    return table(spark, d, "query_log").select(
        "request_id", P.is_conversational(q).alias("conversational"), T.small_talk_reply(q).alias("reply"),
        T.normalise_query(q).alias("query"), T.clamp_top_k(F.col("top_k")).alias("k"),
        F.array_join(T.keywords(q), " ").alias("keywords"), F.array_join(T.keywords(q, distinct=True), " ").alias("distinct_keywords"),
    )


@_query
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select("request_id", T.cache_key(F.col("query_text"), F.coalesce(F.col("top_k"), F.lit(5))).alias("cache_key"))


@_query
def predicate_flags(spark: SparkSession, d: str) -> DataFrame:
    text, query = F.col("content"), F.lit(PHRASE)
    return _chunks(spark, d).select(
        "chunk_row", P.is_boilerplate(text).alias("boilerplate"), P.is_cover_page(text).alias("cover_page"),
        P.is_resume(F.col("document_name"), text, query).alias("resume"), P.is_code_dump(text, query).alias("code_dump"),
    )


@_query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(
        "chunk_row", T.preview(F.col("content")).alias("preview"), T.preview(F.col("content"), 180, collapse=False).alias("summary"), T.base_name(F.col("document_name")).alias("base_name")
    )


@_query
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    found = pipeline.relevant(pipeline.corpus_of_chunks(_chunks(spark, d)), PHRASE, 5)
    return found.select("rank", "id", F.round("score", 5).alias("score"))


@_query
def citations(spark: SparkSession, d: str) -> DataFrame:
    found = pipeline.relevant(pipeline.corpus_of_chunks(_chunks(spark, d)), PHRASE, 5)
    return relevance.citations(found).select("rank", "document", "page", "heading", F.round("score", 5).alias("score"), "preview", "context")


@_query
def relevance_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A query that nothing answers: the first content row comes out whatever its score."""
    found = pipeline.relevant(pipeline.corpus_of_chunks(_chunks(spark, d)), NOTHING, 5)
    return found.select("rank", "id", F.round("score", 5).alias("score"))


@_query
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.prompts(pipeline.relevant(pipeline.corpus_of_chunks(_chunks(spark, d)), PHRASE, 5))


@_query
def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Queries and clients in the place of forwarded and real addresses."""
    log = table(spark, d, "query_log")
    return log.select("request_id", T.client_address(F.col("query_text"), F.col("client_key"), F.col("outcome")).alias("address"))


@_query
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.answers(pipeline.relevant(pipeline.corpus_of_chunks(_chunks(spark, d)), PHRASE, 5))


@_query
def ask(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.ask(pipeline.corpus_of_chunks(_chunks(spark, d)), PHRASE, 5)


@_query
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    found = pipeline.search(pipeline.corpus_of_vectors(table(spark, d, "vector_documents")), PHRASE, 5)
    return found.select("rank", "id", "document_name", F.array_join("sources", "; ").alias("sources"), F.round("score", 5).alias("score"))


@_query
def token_stream(spark: SparkSession, d: str) -> DataFrame:
    return relevance.token_groups(table(spark, d, "query_log"), "request_id", "query_text")


@_query
def browse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.browse(table(spark, d, "vector_documents"))


@_query
def store_status(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.store_status(table(spark, d, "vector_documents"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_jobs")


@_query
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of early runs merged to a ledger, the others then merged into that."""
    runs = table(spark, d, "pipeline_runs").select("pipeline_run_id", "run_no")
    jobs = _jobs(spark, d).join(F.broadcast(runs), "pipeline_run_id", "left")  # a row a run
    late = F.coalesce(F.col("run_no") >= 10, F.lit(False))
    return ledger.upsert(ledger.upsert(jobs.limit(0), jobs.where(~late)), jobs.where(late))


@_query
def ledger_saved(spark: SparkSession, d: str) -> DataFrame:
    """The ledger saved, read back, a run completed and saved again."""
    jobs = _jobs(spark, d)
    first, second = table_path(spark, "ledger"), table_path(spark, "ledger")
    writers.save_ledger(jobs.limit(0), jobs, first)
    saved = readers.read_ledger(spark, first)
    run = saved.where(ledger.state_of(saved) == "VALIDATED").agg(F.min("pipeline_run_id")).first()[0]
    writers.save_ledger(saved.limit(0), ledger.mark_completed(saved, run or ""), second)
    return readers.read_ledger(spark, second).select("checksum", "id", "job_status", "status", "processed_pages", "embedded_chunks", "error_message", "pipeline_run_id")


def _split_jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, d, "pipeline_runs").select("pipeline_run_id", "run_no")
    jobs = _jobs(spark, d).join(runs, "pipeline_run_id")
    return jobs.where(F.col("run_no") >= 10).select("id", "checksum"), jobs.where(F.col("run_no") < 10)


@_query
def skip_set(spark: SparkSession, d: str) -> DataFrame:
    files, old = _split_jobs(spark, d)
    return ledger.skipped(files, old).select("id", F.lit("skip").alias("what")).unionByName(ledger.work_set(files, old).select("id", F.lit("work").alias("what")))


@_query
def resumable_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    return ledger.resumable(jobs).select("id", "filename", "pipeline_run_id")


@_query
def job_states(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    return jobs.select("id", ledger.state_of(jobs).alias("state"), ledger.status_text(ledger.state_of(jobs)).alias("status_text"), ledger.is_completed(jobs).alias("completed"))


@_query
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_jobs(spark, d)).select("id", "filename")


@_query
def last_attempts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_attempts(_jobs(spark, d)).select("id", "filename")


@_query
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.run_report(_jobs(spark, d), _chunks(spark, d))


@_query
def run_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of each run, by the operator for one."""
    runs = [r[0] for r in table(spark, d, "pipeline_runs").select("pipeline_run_id").collect()]  # a row a run
    parts = [ledger.of_run(_jobs(spark, d), r).select("pipeline_run_id", "id") for r in sorted(runs)]
    return reduce(DataFrame.unionByName, parts)


@_query
def parse_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.parse_summary(_jobs(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log")


@_query
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.query_metrics(_log(spark, d))


@_query
def memory_states(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select("p_partkey", guards.memory_state(F.col("p_size").cast("double"), F.lit(50.0)).alias("state"))


@_query
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(_log(spark, d))


@_query
def all_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(_log(spark, d), None)


@_query
def load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.load_percentiles(_log(spark, d))


@_query
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_counts(_log(spark, d))


@_query
def first_token(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_token(_log(spark, d))


@_query
def recent_failures(spark: SparkSession, d: str) -> DataFrame:
    log = metrics.outcome(_log(spark, d))
    return metrics.recent_failure_rate(log, F.col("outcome") != "SUCCESS")


@_query
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hit_rate(guards.expiring_cache(_log(spark, d)))


@_query
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return guards.token_bucket(_log(spark, d))


@_query
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    log = metrics.outcome(_log(spark, d))
    return guards.circuit_breaker(log, F.col("outcome") != "SUCCESS")


@_query
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    return guards.expiring_cache(_log(spark, d))


@_query
def coalesced_requests(spark: SparkSession, d: str) -> DataFrame:
    return guards.coalesced(_log(spark, d))


@_query
def event_last_samples(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 20).groupBy("user_id").agg(
        F.count("*").alias("events"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate")
    )
