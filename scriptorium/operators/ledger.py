"""The job ledger: one row a checksum, upserts, skips, resumable jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

STATES = ("DISCOVERED", "PROCESSING", "VALIDATED", "CHUNKED", "EMBEDDED", "STORED", "COMPLETED", "FAILED", "SKIPPED")
RESUMABLE = ("DISCOVERED", "PROCESSING", "VALIDATED", "CHUNKED", "EMBEDDED", "FAILED")


def parse_status(status: Column) -> Column:
    """The state a status string means; SUCCESS is COMPLETED, an unknown one null."""
    up = F.upper(T.trim(status))
    return F.when(up == "SUCCESS", "COMPLETED").when(up.isin(*STATES), up)


def status_text(state: Column) -> Column:
    """The status string of a state."""
    return F.when(state == "COMPLETED", "SUCCESS").otherwise(state)


def state_of(jobs: DataFrame) -> Column:
    """The state of a job: `job_status`, where it is missing what `status` means."""
    return F.coalesce(parse_status(jobs["job_status"]), parse_status(jobs["status"]))


def is_completed(jobs: DataFrame) -> Column:
    return F.coalesce(state_of(jobs) == "COMPLETED", F.lit(False)) | F.coalesce(F.upper(T.trim(jobs["status"])) == "SUCCESS", F.lit(False))


def safe_checksum(checksum: Column, filename: Column) -> Column:
    """The checksum, for a blank one a stand-in made of the file's name."""
    return F.when(T.is_blank(checksum), F.concat(F.lit("unknown_"), T.text_of(filename))).otherwise(checksum)


SCHEMA = (
    "id long, filename string, checksum string, total_pages int, processed_pages int, total_chunks int, embedded_chunks int, job_status string, "
    "status string, pipeline_run_id string, execution_time_ms long, error_message string, failure_reason string, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, processed_at timestamp_ntz"
)
_COLUMNS = [c.split(" ") for c in SCHEMA.split(", ")]


def full(jobs: DataFrame) -> DataFrame:
    """Jobs with all columns of the ledger, in its order and types; missing ones are null, others are left out."""
    return jobs.select(*((F.col(c) if c in jobs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS))


def upsert(ledger: DataFrame, updates: DataFrame, seq: str = "id") -> DataFrame:
    """The ledger with updates applied, in the ledger's own schema: one row a checksum, the last attempt by `seq`.

    What an attempt leaves null of its chunks, times and duration stays as it was, the start is the first
    one's. An attempt without an error keeps the error before it; a completed one has none. The result can
    be updated again: upsert(upsert(l, a), b) is upsert(l, a and b) for later attempts b. Attempts of one
    checksum are reduced by aggregates, not gathered.
    """
    rows = full(ledger).unionByName(full(updates))
    rows = rows.withColumn("checksum", safe_checksum(F.col("checksum"), F.col("filename"))).withColumn("_state", state_of(rows))
    error = F.coalesce(F.col("error_message"), F.col("failure_reason"))
    done = F.when(F.col("_state") == "COMPLETED", F.col(seq))
    carried = ("total_chunks", "embedded_chunks", "execution_time_ms", "completed_at")
    last = rows.groupBy("checksum").agg(
        F.max_by(F.struct("id", "filename", "total_pages", "processed_pages", "pipeline_run_id", "_state", "processed_at"), seq).alias("l"),
        F.max_by(F.when(error.isNotNull(), F.struct(F.col(seq).alias("at"), error.alias("text"))), F.when(error.isNotNull(), F.col(seq))).alias("e"),
        F.max(done).alias("done_at"),
        F.min_by("started_at", F.when(F.col("started_at").isNotNull(), F.col(seq))).alias("started_at"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in carried),
    )
    completed = F.col("l._state") == "COMPLETED"
    message = F.when(~F.coalesce(completed, F.lit(False)) & (F.col("done_at").isNull() | (F.col("e.at") > F.col("done_at"))), F.col("e.text"))
    merged = last.select(
        "l.id", "l.filename", "checksum", "l.total_pages",
        F.when(completed, F.col("l.total_pages")).otherwise(F.col("l.processed_pages")).alias("processed_pages"),
        "total_chunks", "embedded_chunks", F.col("l._state").alias("job_status"), status_text(F.col("l._state")).alias("status"),
        "l.pipeline_run_id", "execution_time_ms", message.alias("error_message"), message.alias("failure_reason"),
        "started_at", "completed_at", "l.processed_at",
    )
    return full(merged)


def mark_completed(ledger: DataFrame, run_id: str) -> DataFrame:
    """The ledger after a run: its validated jobs are completed, without errors; all others, also those of no run, stay as they are."""
    hit = F.coalesce((F.col("pipeline_run_id") == run_id) & (state_of(ledger) == "VALIDATED"), F.lit(False))
    return ledger.withColumns(
        {
            "job_status": F.when(hit, "COMPLETED").otherwise(F.col("job_status")),
            "status": F.when(hit, "SUCCESS").otherwise(F.col("status")),
            "processed_pages": F.when(hit, F.col("total_pages")).otherwise(F.col("processed_pages")),
            "embedded_chunks": F.when(hit, F.col("total_chunks")).otherwise(F.col("embedded_chunks")),
            "error_message": F.when(~hit, F.col("error_message")),
            "failure_reason": F.when(~hit, F.col("failure_reason")),
        }
    )


def mark_failed(ledger: DataFrame, checksum: str, message: str) -> DataFrame:
    """The ledger with a checksum's job failed."""
    hit = F.coalesce(F.col("checksum") == checksum, F.lit(False))
    return ledger.withColumns(
        {
            "job_status": F.when(hit, "FAILED").otherwise(F.col("job_status")),
            "status": F.when(hit, "FAILED").otherwise(F.col("status")),
            "error_message": F.when(hit, message[:4000]).otherwise(F.col("error_message")),
            "failure_reason": F.when(hit, message[:4000]).otherwise(F.col("failure_reason")),
        }
    )


def work_set(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files whose checksum no completed job has. Completed jobs stay completed when their file is skipped."""
    return files.join(ledger.where(is_completed(ledger)).select("checksum").distinct(), "checksum", "left_anti")


def skipped(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files whose checksum a completed job has."""
    return files.join(ledger.where(is_completed(ledger)).select("checksum").distinct(), "checksum", "left_semi")


def resumable(ledger: DataFrame) -> DataFrame:
    return ledger.where(state_of(ledger).isin(*RESUMABLE))


def of_run(ledger: DataFrame, run_id: str) -> DataFrame:
    return ledger.where(F.col("pipeline_run_id") == run_id)


def latest(ledger: DataFrame) -> DataFrame:
    """The job processed last; ties by the greater id, jobs never processed last of all."""
    return ledger.orderBy(F.col("processed_at").desc_nulls_last(), F.desc("id")).limit(1)


def last_attempts(jobs: DataFrame) -> DataFrame:
    """The last attempt of each file, by id."""
    order = Window.partitionBy("filename").orderBy(F.desc("id"))
    return jobs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def parse_summary(jobs: DataFrame) -> DataFrame:
    """(discovered, processed, failed, pages, elapsed_ms, pages_per_second) of the jobs of a run."""
    state = state_of(jobs)
    out = jobs.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.coalesce(state != "FAILED", F.lit(True))).alias("processed"),
        F.count_if(state == "FAILED").alias("failed"),
        F.coalesce(F.sum("processed_pages"), F.lit(0)).alias("pages"),
        F.greatest(F.lit(1), F.coalesce(F.max("execution_time_ms"), F.lit(0))).alias("elapsed_ms"),
    )
    return out.withColumn("pages_per_second", F.round(F.col("pages") * 1000.0 / F.col("elapsed_ms"), 2))
