"""Operational analytics over request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

RESERVOIR = 2048


def latest_samples(log: DataFrame, n: int = RESERVOIR) -> DataFrame:
    """The last n rows by (ts, request_id) that have a latency."""
    return log.where(F.col("latency_ms").isNotNull()).orderBy(F.col("ts").desc_nulls_last(), F.desc("request_id")).limit(n)


def _ranked(log: DataFrame) -> DataFrame:
    """(latency_ms, upto, n): each different latency with the number of samples up to it, and of all samples.

    Running counts within logarithmic bins; no sorted list is collected, no task holds all values.
    """
    values = log.where(F.col("latency_ms").isNotNull()).groupBy("latency_ms").agg(F.count("*").alias("c"))
    bins = values.withColumn("bin", F.floor(F.log2(F.greatest(F.abs("latency_ms"), F.lit(1e-6))) * 64) * F.signum("latency_ms"))
    starts = bins.groupBy("bin").agg(F.sum("c").alias("m"), F.min("latency_ms").alias("least"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin: a few thousand
    starts = starts.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).select("bin", "start")
    inside = Window.partitionBy("bin").orderBy("latency_ms")
    ranked = bins.join(starts, "bin").withColumn("upto", F.col("start") + F.sum("c").over(inside))
    return ranked.join(F.broadcast(values.agg(F.sum("c").alias("n"))))  # one row


def percentiles(log: DataFrame, n: int | None = RESERVOIR) -> DataFrame:
    """(samples, p50, p95, p99) of latencies by nearest rank, over the last n rows or all; 0 without any."""
    ranked = _ranked(latest_samples(log, n) if n else log)
    exprs = [
        F.coalesce(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("latency_ms"))), F.lit(0.0)).alias(name)
        for name, p in (("p50", F.lit("0.50").cast("decimal(3,2)")), ("p95", F.lit("0.95").cast("decimal(3,2)")), ("p99", F.lit("0.99").cast("decimal(3,2)")))
    ]
    return ranked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("samples"), *exprs)


def load_percentiles(log: DataFrame) -> DataFrame:
    """(p50, p95, p99) by the load test's rule, the value at index floor(n * p), from counts of equal latencies."""
    return _ranked(log).agg(
        *(
            F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("latency_ms"))).alias(name)
            for name, p in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
        )
    )


def outcome(log: DataFrame) -> DataFrame:
    """The log with `outcome` in capitals without blanks at the ends; null is UNKNOWN."""
    return log.withColumn("outcome", F.coalesce(F.upper(T.trim(F.col("outcome"))), F.lit("UNKNOWN")))


def outcome_counts(log: DataFrame) -> DataFrame:
    """(outcome, requests)."""
    return outcome(log).groupBy("outcome").agg(F.count("*").alias("requests"))


def first_token(log: DataFrame) -> DataFrame:
    """(samples, mean_first_token_ms) with two decimals; 0 without samples."""
    return log.agg(F.count("first_token_ms").alias("samples"), F.round(F.coalesce(F.avg("first_token_ms"), F.lit(0.0)), 2).alias("mean_first_token_ms"))


def hit_rate(accesses: DataFrame, hit: str = "hit") -> DataFrame:
    """(hits, misses, hit_rate): percent with two decimals; 0 without accesses."""
    out = accesses.agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    return out.withColumn("hit_rate", T.percent(F.col("hits"), F.col("hits") + F.col("misses")))


def recent_failure_rate(log: DataFrame, failed, key: str = "client_key", n: int = 20) -> DataFrame:
    """(request_id, calls, failure_rate): the share of failures among a key's last n calls up to each."""
    order = Window.partitionBy(key).orderBy("ts", "request_id").rowsBetween(-(n - 1), 0)
    return log.select(
        "request_id", F.count("*").over(order).alias("calls"), F.round(F.avg(failed.cast("double")).over(order), 6).alias("failure_rate")
    )
