"""Problem 6: new batches against everything accepted before.

A `History` is a store in a folder: of every accepted content its fingerprint, its min-hash values in
TREES blocks, each a key of that block's table (the position in the array is the table, its parts are
turned against each other as in `near_copies`), its sketch, the hashes of its symbols, and its text.

- `sign` fingerprints a batch, the only step that reads the batch's texts as a whole;
- `look_up` finds exact block matches with the history, and among the runs of the batch, compares the
  candidates' sketches by their differing bits, which bound the common shingles, then their texts;
- `append` adds what was accepted. No text of the history is hashed again: of the store a look-up
  reads fingerprints, and texts of candidates to verify them.

Fingerprints of single bits, as of simhash, can't serve here: at the required share of 0.6 common
shingles 64 such bits differ in 15 places on average, and blocks short enough to agree match a large
part of the history by chance. The README has the figures.

A row is a case if it is a copy of, or similar to, an accepted row of an earlier run; rows of one
run aren't compared with each other. A content's fate is settled in the first run that has it: if it
is accepted there, all later rows of it are copies of it; if it is a case, what made it one is still
in the history later. A batch may hold several runs: they are settled in order. Rows whose run isn't
known, null, empty and short texts are no cases and enter no history. An append that is repeated, as
after a failure, replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import near_copies
from scriptorium.llm.near_copies import CLASS
from scriptorium.operators.skew import join_groups
from scriptorium.session import table_path, write_table

CHECKSUM = r"(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])"
_ROW = ["src_table", "row_id"]
_CONTENTS = (
    "src_table string, row_id long, w1 long, w2 long, k1 long, k2 long, f1 long, f2 long, n int, labels array<long>, sketch binary, run_no int"
)
_TEXTS = "src_table string, row_id long, text string"
_JOBS = "sum string, run_no int"
BATCHES = 2


class History:
    """The accepted contents and checksums of all batches so far, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{part}")

    def contents(self) -> DataFrame:
        return self._read("contents", _CONTENTS)

    def texts(self) -> DataFrame:
        return self._read("texts", _TEXTS)

    def jobs(self) -> DataFrame:
        return self._read("jobs", _JOBS)

    def append(self, batch: str, found: Found, rows: DataFrame) -> None:
        """Add the accepted contents of a batch, their texts first: what isn't in `contents` isn't in the history.

        Texts with too few words stay in, as telling them apart would cost more; nothing looks them up.
        """
        texts = rows.select(*_ROW, "text").join(found.refused, _ROW, "left_anti")
        texts.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/texts/{batch}")
        found.accepted.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/contents/{batch}")

    def append_jobs(self, batch: str, accepted: DataFrame) -> None:
        accepted.write.mode("overwrite").parquet(f"{self.path}/jobs/{batch}")


@dataclass
class Found:
    """What a look-up gives: the cases (src_table, row_id), the accepted contents with their fingerprints, the rows that are none of these."""

    cases: DataFrame
    accepted: DataFrame
    refused: DataFrame


def with_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of known runs with their `run_no`."""
    return rows.join(F.broadcast(runs.select("pipeline_run_id", "run_no")), "pipeline_run_id")  # a row a run


def sign(rows: DataFrame) -> DataFrame:
    """The fingerprints of a batch (src_table, row_id, text, run_no), rows with enough words only."""
    return near_copies.signatures(rows, "run_no")


def _by_key(classes: DataFrame) -> DataFrame:
    """(key, rep, run_no): classes by what copies share, their symbols and their lists of fields."""
    sides = F.array(
        F.struct(F.lit("k").alias("kind"), F.col("k1").alias("x1"), F.col("k2").alias("x2")),
        F.struct(F.lit("f").alias("kind"), F.col("f1").alias("x1"), F.col("f2").alias("x2")),
    )
    keyed = classes.select("src_table", F.col("row_id").alias("rep"), "run_no", F.explode(sides).alias("s"))
    return keyed.where("s.kind = 'k' or s.x1 <> 0").select("src_table", "s.kind", "s.x1", "s.x2", "rep", "run_no")


_KEY = ["src_table", "kind", "x1", "x2"]


def settle(links: DataFrame, shared: DataFrame, run_numbers: list[int]) -> DataFrame | None:
    """(src_table, rep) of the classes of a batch that are cases for what earlier runs of the batch accepted, run by run.

    links: (src_table, a, b, run_no), run_no being b's; shared: `_by_key` rows of keys that occur in
    several runs. A class is a case if a linked class, or one with a key of its own, was accepted.
    Each run adds its cases to a written table that the later runs read.
    """
    cases = None
    for run in run_numbers:
        earlier, own, current = shared.where(F.col("run_no") < run), shared.where(F.col("run_no") == run), links.where(F.col("run_no") == run)
        if cases is not None:
            earlier = earlier.join(cases, ["src_table", "rep"], "left_anti")
            current = current.join(cases.withColumnRenamed("rep", "a"), ["src_table", "a"], "left_anti")
        copies = own.join(earlier.select(*_KEY).distinct(), _KEY, "left_semi").select("src_table", "rep")
        new = write_table(current.select("src_table", F.col("b").alias("rep")).unionByName(copies).distinct(), f"history-cases-{run}")
        cases = new if cases is None else cases.unionByName(new)
    return cases


def look_up(signed: DataFrame, rows: DataFrame, history: History) -> Found:
    """The cases of a signed batch against the history and the earlier runs of the batch itself.

    rows: the batch with its texts. The runs of the batch must be later than those of the history.
    """
    classes = signed.groupBy(*CLASS).agg(F.min(F.struct("run_no", "row_id")).alias("first"), F.count("*").alias("n_rows"))
    classes = classes.where("n_rows > 1").select(*CLASS, F.col("first.row_id").alias("rep"), "n_rows")
    reps, others = near_copies.representatives(signed, write_table(classes, "history-classes"), "run_no")
    reps = reps.select(*(c.split(" ")[0] for c in _CONTENTS.split(", ")))
    old = history.contents()
    runs = sorted(r["run_no"] for r in reps.select("run_no").distinct().collect())  # a row a run
    if not runs:
        return Found(signed.select(*_ROW).limit(0), reps, others.select(*_ROW))
    keys = write_table(_by_key(reps), "history-keys")
    known = keys.join(_by_key(old).select(*_KEY), _KEY, "left_semi").select("src_table", "rep").distinct()
    known = write_table(known, "history-known")
    fresh = reps.join(known.withColumnRenamed("rep", "row_id"), _ROW, "left_anti")
    texts = rows.select(*_ROW, "text").unionByName(history.texts())
    similar = near_copies.class_links(texts, fresh.unionByName(old), "run_no", runs[0])
    ends = similar.select("src_table", "a", "b")
    ends = ends.join(reps.select("src_table", F.col("row_id").alias("a"), F.col("run_no").alias("_ra")), ["src_table", "a"], "left")
    ends = write_table(ends.join(reps.select("src_table", F.col("row_id").alias("b"), "run_no"), ["src_table", "b"]), "history-links")
    met = ends.where(F.col("_ra").isNull()).select("src_table", F.col("b").alias("rep")).unionByName(known).distinct()
    met = write_table(met, "history-met")  # cases for what the history holds
    within = ends.where(F.col("_ra").isNotNull()).join(met.withColumnRenamed("rep", "a"), ["src_table", "a"], "left_anti").drop("_ra")
    several = keys.groupBy(*_KEY).agg(F.count("*").alias("_n"), F.min("run_no").alias("_low"), F.max("run_no").alias("_high")).where("_low < _high")
    several = write_table(several.drop("_low", "_high"), "history-several")  # read several times
    shared = join_groups(keys, several, _KEY, "_n").drop("_n")
    shared = write_table(shared.join(met, ["src_table", "rep"], "left_anti"), "history-shared")
    cases = settle(within, shared, runs[1:]) if len(runs) > 1 else None
    cases = met if cases is None else cases.unionByName(met).distinct()
    cases = write_table(cases, "history-cases")
    named = cases.withColumnRenamed("rep", "row_id")
    firsts = reps.select("src_table", F.col("row_id").alias("rep"), F.col("run_no").alias("first_run"))
    counts = others.groupBy("src_table", "rep").agg(F.count("*").alias("_n")).join(firsts, ["src_table", "rep"]).join(cases.withColumn("_case", F.lit(True)), ["src_table", "rep"], "left")
    later = join_groups(others, counts, ["src_table", "rep"], "_n").where(F.col("_case") | (F.col("run_no") > F.col("first_run")))
    return Found(named.unionByName(later.select(*_ROW)), reps.join(named, _ROW, "left_anti"), named.unionByName(others.select(*_ROW)))


def checksums(jobs: DataFrame) -> DataFrame:
    """(id, run_no, sum, done): the jobs whose value holds a checksum."""
    checksum = F.lower(F.regexp_extract("checksum", CHECKSUM, 1))
    return jobs.select(
        "id",
        "run_no",
        F.when(checksum != "", checksum).alias("sum"),
        F.coalesce((F.upper(F.trim("job_status")) == "COMPLETED") | (F.upper(F.trim("status")) == "SUCCESS"), F.lit(False)).alias("done"),
    ).where(F.col("sum").isNotNull())


def accepted_checksums(numbered: DataFrame) -> DataFrame:
    """(sum, run_no): the checksums accepted in a batch, with the first run that did."""
    return numbered.where("done").groupBy("sum").agg(F.min("run_no").alias("run_no"))


def repeated_jobs(numbered: DataFrame, history: DataFrame) -> DataFrame:
    """(id): jobs of a batch whose checksum an accepted job of an earlier run has, in the history or in the batch.

    Values without a checksum match nothing.
    """
    sums = numbered.groupBy("sum").agg(F.min(F.when(F.col("done"), F.col("run_no"))).alias("first"), F.count("*").alias("n"))
    first = sums.join(history.select("sum", F.col("run_no").alias("_old")), "sum", "left").select("sum", "n", F.least("first", "_old").alias("first"))
    return join_groups(numbered, first, ["sum"], "n").where(F.col("first") < F.col("run_no")).select("id")


def check_chunks(rows: DataFrame, history: History, batch: str) -> DataFrame:
    """Sign a batch, look it up, append what is accepted; (src_table, row_id) of its cases."""
    found = look_up(sign(rows), rows, history)
    history.append(batch, found, rows)
    return found.cases


def check_jobs(jobs: DataFrame, history: History, batch: str) -> DataFrame:
    """Look a batch of jobs (with run_no) up, append what is accepted; (id) of its cases."""
    numbered = write_table(checksums(jobs), "history-sums")
    old = history.jobs()
    cases = write_table(repeated_jobs(numbered, old.groupBy("sum").agg(F.min("run_no").alias("run_no"))), "history-jobs")
    history.append_jobs(batch, accepted_checksums(numbered).join(old, "sum", "left_anti"))
    return cases


def find_repeats(chunks: DataFrame, jobs: DataFrame, runs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(kind, row_id): jobs and chunks that bring nothing new against the earlier runs.

    All runs are replayed, oldest first, in this number of batches against one growing history.
    """
    spark = chunks.sparkSession
    numbers = sorted(r["run_no"] for r in runs.select("run_no").distinct().collect())  # one row a run
    history = History(spark, table_path(spark, "history"))
    size = max(1, -(-len(numbers) // batches))
    out = spark.createDataFrame([], "kind string, row_id long")
    rows = with_run(chunks, runs).select(F.lit("rag_chunks").alias("src_table"), F.col("chunk_row").alias("row_id"), F.col("content").alias("text"), "run_no")
    for at in range(0, len(numbers), size):
        some = F.col("run_no").between(numbers[at], numbers[min(at + size, len(numbers)) - 1])
        old_chunks = check_chunks(rows.where(some), history, f"batch-{at}")
        old_jobs = check_jobs(with_run(jobs, runs).where(some), history, f"batch-{at}")
        out = out.unionByName(old_chunks.select(F.lit("chunk").alias("kind"), "row_id"))
        out = out.unionByName(old_jobs.select(F.lit("job").alias("kind"), F.col("id").alias("row_id")))
    return out
