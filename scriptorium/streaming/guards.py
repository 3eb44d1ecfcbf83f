"""The keyed state machines as streaming operators, and streaming ingestion."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.functions import text as T
from scriptorium.operators import guards as G
from scriptorium.operators.chunking import chunk_documents


#: A key's state goes when the stream's time is this far beyond the key's last event; longer than any time to live or refill.
IDLE_MS = 24 * 3_600_000


def _stepped(machine: Callable[[], object], out: str, convert: Callable, idle_ms: int):
    names = ["request_id", "key", "flag", out]

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        current, last = pickle.loads(state.get[0]) if state.exists else (machine(), 0)  # noqa: S301 - written by this operator
        # a key's events of one micro-batch come in several frames; they are put in order as a whole
        events = pd.concat([frame[["ms", "request_id", "value"]] for frame in frames]).sort_values(["ms", "request_id"])
        rows = []
        for ms, request, value in events.itertuples(index=False):
            flag, extra = current.step(int(ms), None if pd.isna(value) else value)
            rows.append((int(request), key[0], bool(flag), convert(extra)))
            last = max(last, int(ms))
        state.update((pickle.dumps((current, last)),))
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame(rows, columns=names)

    return run


def stream_fold(events: DataFrame, key, machine: Callable[[], object], value, out: str, out_type: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """`operators.guards.fold` over a stream: one state a key; each micro-batch of a key is put in order of time as a whole.

    A key's events of one micro-batch are held at once, so its size is bounded by the trigger. States
    are dropped once the newest event of the stream is `idle_ms` beyond the key's last; events that come
    later than that behind the newest are left out, as their state may be gone.
    """
    named = events.where(F.col("ts").isNotNull()).select(
        F.when(T.is_blank(key), "anonymous").otherwise(key).alias("key"),
        F.col("ts").cast("timestamp").alias("at"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        "request_id",
        value.alias("value"),
    )
    convert = str if out_type == "string" else float
    return named.withWatermark("at", f"{idle_ms} milliseconds").groupBy("key").applyInPandasWithState(
        _stepped(machine, out, convert, idle_ms), f"request_id long, key string, flag boolean, {out} {out_type}", "state binary", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def token_bucket(events: DataFrame) -> DataFrame:
    return stream_fold(events, F.col("client_key"), G.TokenBucket, F.lit(None).cast("double"), "tokens", "double")


def circuit_breaker(events: DataFrame, failed) -> DataFrame:
    return stream_fold(events, F.col("client_key"), G.CircuitBreaker, failed.cast("double"), "state", "string")


def expiring_cache(events: DataFrame, ttl_ms: int = G.ANSWER_TTL_MS) -> DataFrame:
    key = T.cache_key(F.col("query_text"), F.coalesce(F.col("top_k"), F.lit(5)))
    return stream_fold(events, key, lambda: G.ExpiringEntry(ttl_ms), F.lit(None).cast("double"), "expires_ms", "double")


def coalesced(events: DataFrame, within: str = "10 seconds") -> DataFrame:
    """Requests of one query and k within a span of time reduced to the first."""
    key = F.concat(F.lower(T.normalise_query(F.col("query_text"))), F.lit(":"), F.coalesce(F.col("top_k"), F.lit(5)).cast("string"))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("flight", key).withWatermark("ts", within).dropDuplicatesWithinWatermark(["flight"])


def chunk_stream(documents: DataFrame) -> DataFrame:
    """Chunks of a stream of staged documents; the fold is narrow, so it needs no state."""
    return chunk_documents(documents)
