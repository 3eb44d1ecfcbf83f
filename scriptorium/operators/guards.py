"""Keyed state machines over ordered events: token bucket, circuit breaker, expiring cache, coalescing.

Each is a fold whose next state depends on all events of its key so far. Rows are partitioned by key
and sorted; a task streams them and holds one state at a time, never a key's rows. A single key's
events are processed in sequence by nature of the operator. Events without a time are left out; ties
of time are broken by the request's number; a null key counts as `anonymous`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

BURST, REFILL = 30.0, 1.0
RING, LEAST_CALLS, FAILURE_RATE, RESET_MS = 20, 10, 0.5, 5000
ANSWER_TTL_MS, EMBEDDING_TTL_MS = 15 * 60_000, 2 * 3_600_000


class TokenBucket:
    """Starts full; refilled continuously; a request costs one token."""

    def __init__(self, burst: float = BURST, refill: float = REFILL) -> None:
        self.burst, self.refill, self.tokens, self.at = burst, refill, burst, None

    def step(self, ms: int, value: object) -> tuple[bool, float]:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + (ms - self.at) / 1000 * self.refill)
        self.at = ms
        allowed = self.tokens >= 1
        if allowed:
            self.tokens -= 1
        return allowed, round(self.tokens, 6)


class CircuitBreaker:
    """CLOSED, OPEN after too many failures, HALF_OPEN for a trial once the reset time is over."""

    def __init__(self) -> None:
        self.state, self.since, self.ring = "CLOSED", 0, deque(maxlen=RING)

    def step(self, ms: int, failed: object) -> tuple[bool, str]:
        if self.state == "OPEN":
            if ms - self.since < RESET_MS:
                return False, self.state
            self.state, self.since = "HALF_OPEN", ms
        self.ring.append(bool(failed))
        if failed:
            tripped = self.state == "CLOSED" and len(self.ring) >= LEAST_CALLS and sum(self.ring) / len(self.ring) >= FAILURE_RATE
            if self.state == "HALF_OPEN" or tripped:
                self.state, self.since = "OPEN", ms
        elif self.state == "HALF_OPEN":
            self.state, self.since = "CLOSED", ms
            self.ring.clear()
        return True, self.state


class ExpiringEntry:
    """A miss stores the entry anew; a hit within the time to live doesn't prolong it."""

    def __init__(self, ttl_ms: int = ANSWER_TTL_MS) -> None:
        self.ttl, self.expires = ttl_ms, None

    def step(self, ms: int, value: object) -> tuple[bool, float]:
        hit = self.expires is not None and ms <= self.expires
        if not hit:
            self.expires = ms + self.ttl
        return hit, float(self.expires or 0)


class SingleFlight:
    """Requests that arrive while one of their key is under way share its computation."""

    def __init__(self) -> None:
        self.ends = None

    def step(self, ms: int, duration: object) -> tuple[bool, float]:
        shared = self.ends is not None and ms < self.ends
        if not shared:
            self.ends = ms + max(0.0, float(duration or 0.0))
        return shared, float(self.ends or 0)


def fold(events: DataFrame, key: Column, machine: Callable[[], object], value: Column, out: str, out_type: str) -> DataFrame:
    """(request_id, key, flag, out): the machine of each key stepped through its events (request_id, ts)."""
    named = events.where(F.col("ts").isNotNull()).select(
        F.when(T.is_blank(key), "anonymous").otherwise(key).alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        "request_id",
        value.alias("value"),
    )
    kind = pa.string() if out_type == "string" else pa.float64()
    schema = pa.schema([("request_id", pa.int64()), ("key", pa.string()), ("flag", pa.bool_()), (out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, machine()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "ms", "request_id", "value")]
            rows = []
            for k, ms, request, v in zip(*columns):
                if k != current:
                    current, state = k, machine()
                rows.append((request, k, *state.step(ms, v)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    ordered = named.repartition("key").sortWithinPartitions("key", "ms", "request_id")
    return ordered.mapInArrow(run, f"request_id long, key string, flag boolean, {out} {out_type}")


def token_bucket(log: DataFrame) -> DataFrame:
    """(request_id, key, allowed, tokens) of each request of each client."""
    return fold(log, F.col("client_key"), TokenBucket, F.lit(None).cast("double"), "tokens", "double").withColumnRenamed("flag", "allowed")


def circuit_breaker(log: DataFrame, failed: Column) -> DataFrame:
    """(request_id, key, allowed, state) of each call of each client's breaker."""
    return fold(log, F.col("client_key"), CircuitBreaker, failed, "state", "string").withColumnRenamed("flag", "allowed")


def expiring_cache(log: DataFrame, ttl_ms: int = ANSWER_TTL_MS) -> DataFrame:
    """(request_id, key, hit, expires_ms) of each access by query and k."""
    key = T.cache_key(F.col("query_text"), F.coalesce(F.col("top_k"), F.lit(5)))
    return fold(log, key, lambda: ExpiringEntry(ttl_ms), F.lit(None).cast("double"), "expires_ms", "double").withColumnRenamed("flag", "hit")


def coalesced(log: DataFrame) -> DataFrame:
    """(request_id, key, shared, ends_ms) of each request by query and k."""
    key = F.concat(F.lower(T.normalise_query(F.col("query_text"))), F.lit(":"), F.coalesce(F.col("top_k"), F.lit(5)).cast("string"))
    return fold(log, key, SingleFlight, F.col("latency_ms"), "ends_ms", "double").withColumnRenamed("flag", "shared")


def memory_state(used: Column, most: Column) -> Column:
    """NORMAL below 75 % of the memory, WARNING below 90 %, else CRITICAL."""
    share = used / most
    return F.when(share < 0.75, "NORMAL").when(share < 0.90, "WARNING").otherwise("CRITICAL")
