"""Problem 9: filling containers of fixed capacity with documents.

Only sizes matter for packing, and there are at most `capacity` different ones. So the driver packs
the histogram of sizes, never the documents: sizes in falling order, each group of equal items into
the open bins with the least sufficient room (best fit), else into new bins of the permitted length
that costs least for them; at last each bin is downsized to the least permitted length that holds
its contents. The permitted lengths are chosen jointly: every set of them that may be opened is packed,
and the plan with the fewest containers stands, of these the one with the least length after downsizing.
Bins of equal content are ranges of bin numbers, so the plan's length depends on the
capacity alone. Documents then look up their bin by size and rank among the documents of that size.

Documents without tokens (null or empty texts) are spread over all bins. A document above the
capacity is cut into full bins and a rest; no other is cut.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.frames import map_batches
from scriptorium.session import write_table

CAPACITY = 2048
LENGTHS = (256, 512, 1024, 1536, 2048)  # that bins may have; 2 ** (len - 1) sets of them are tried
#: Ranks are counted within (size, bucket): at most (CAPACITY + 1) * BUCKETS groups, however many documents.
BUCKETS = 256


@dataclass
class Placement:
    """`bins` bins from `first_bin` on take `per_bin` items each, at `offset`, from rank `rank` on."""

    size: int
    rank: int
    bins: int
    per_bin: int
    first_bin: int
    offset: int


def pack_jointly(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[Placement], list[tuple[int, int, int]]]:
    """The best of the plans that open only some of the permitted lengths, the longest always among them.

    Fewest bins come first, then the least sum of their lengths after downsizing to any permitted one.
    """
    *short, longest = sorted(lengths)
    plans = [
        pack_histogram(counts, (*some, longest), tuple(lengths)) for n in range(len(short) + 1) for some in combinations(short, n)
    ]
    return min(plans, key=lambda p: (sum(bins for _, bins, _ in p[1]), sum(bins * length for _, bins, length in p[1])))


def pack_histogram(
    counts: dict[int, int], lengths: tuple[int, ...] = (CAPACITY,), permitted: tuple[int, ...] | None = None
) -> tuple[list[Placement], list[tuple[int, int, int]]]:
    """Pack counts[size] items of each size into bins opened with one of `lengths`, at last downsized to a `permitted` one.

    Returns the placements and (first_bin, bins, length) for ranges of bins, lengths downsized.
    """
    lengths = tuple(sorted(lengths))
    permitted = tuple(sorted(permitted or lengths))
    room: dict[int, list[tuple[int, int, int]]] = {}  # remaining room -> (first_bin, bins, length)
    rooms: list[int] = []
    plan: list[Placement] = []
    opened = 0

    def put(remaining: int, first: int, bins: int, length: int) -> None:
        if bins:
            if remaining not in room:
                bisect.insort(rooms, remaining)
                room[remaining] = []
            room[remaining].append((first, bins, length))

    for size in sorted((s for s, c in counts.items() if s > 0 and c > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                length = min((x for x in lengths if x >= size), key=lambda x: (x / (x // size), -x))
                fit = length // size
                for bins, each in ((left // fit, fit), (1, left % fit)):
                    if bins and each:
                        plan.append(Placement(size, rank, bins, each, opened, 0))
                        put(length - size * each, opened, bins, length)
                        opened += bins
                        rank += bins * each
                left = 0
                continue
            remaining = rooms[at]
            first, bins, length = room[remaining].pop()
            if not room[remaining]:
                del room[remaining]
                rooms.pop(at)
            used = min(bins, left)
            put(remaining, first + used, bins - used, length)
            plan.append(Placement(size, rank, used, 1, first, length - remaining))
            put(remaining - size, first, used, length)
            rank += used
            left -= used
    shrunk = sorted(
        (first, bins, next(x for x in permitted if x >= length - remaining))
        for remaining, parts in room.items()
        for first, bins, length in parts
    )
    return plan, shrunk


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """(key, piece, bin_id, bin_length, bin_offset, n_tokens): where each document, or each piece of a cut one, lies.

    `lengths` are the permitted bin lengths, the largest of them the capacity; by default LENGTHS up to it.
    """
    lengths = lengths or (*(x for x in LENGTHS if x < capacity), capacity)
    spark = sizes.sparkSession
    pieces = write_table(
        sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
        .select("_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(_n - 1) div {capacity}")))).alias("piece"))
        .select(
            "_key",
            F.col("piece").cast("int").alias("piece"),
            F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias("_size"),
        )
        .withColumn("_bucket", F.pmod(F.xxhash64("_key", "piece"), F.lit(BUCKETS)).cast("int")),
        "pieces",
    )
    groups = pieces.groupBy("_size", "_bucket").agg(F.count("*").alias("_c"))
    groups = write_table(groups, "piece-counts")
    counts = {r["_size"]: r["c"] for r in groups.groupBy("_size").agg(F.sum("_c").alias("c")).collect()}  # <= capacity + 1 rows
    plan, ranges = pack_jointly(counts, lengths)
    n_bins = max([1, *(first + bins for first, bins, _ in ranges)])
    offsets = groups.select(
        "_size",
        "_bucket",
        (F.sum("_c").over(Window.partitionBy("_size").orderBy("_bucket")) - F.col("_c")).alias("_before"),
    )
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("_key", "piece")) - 1)
        .join(F.broadcast(offsets), ["_size", "_bucket"])  # at most (capacity + 1) * BUCKETS rows
        .select("_key", "piece", "_size", (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    )
    plan.sort(key=lambda p: (p.size, p.rank))
    table = np.array([[p.size, p.rank, p.bins, p.per_bin, p.first_bin, p.offset] for p in plan] or [[0] * 6], np.int64)
    ends = np.array([[first, length] for first, _, length in ranges] or [[0, lengths[0]]], np.int64)
    shared = spark.sparkContext.broadcast((table, ends))  # its length depends on the capacity only

    def place(batch) -> dict[str, object]:
        table, ends = shared.value
        n = batch.column("_size").to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
        span = 1 << 40
        at = np.maximum(np.searchsorted(table[:, 0] * span + table[:, 1], n * span + rank, side="right") - 1, 0)
        _, begin, _, per_bin, first, offset = table[at].T
        inside = rank - begin
        per_bin = np.maximum(per_bin, 1)
        bin_id = np.where(n > 0, first + inside // per_bin, rank % n_bins)
        length = ends[np.maximum(np.searchsorted(ends[:, 0], bin_id, side="right") - 1, 0), 1]
        return {
            key: batch.column("_key"),
            "piece": batch.column("piece"),
            "bin_id": bin_id,
            "bin_length": length.astype(np.int32),
            "bin_offset": np.where(n > 0, offset + (inside % per_bin) * n, 0).astype(np.int32),
            "n_tokens": n.astype(np.int32),
        }

    schema = f"{key} {dict(sizes.dtypes)[key]}, piece int, bin_id long, bin_length int, bin_offset int, n_tokens int"
    return map_batches(ranked, schema, place)


def unused(packed: DataFrame) -> DataFrame:
    """(bin_length, bins, n_tokens, unused): the space left over in the bins of each length."""
    bins = packed.groupBy("bin_id", "bin_length").agg(F.sum("n_tokens").alias("n"))
    return bins.groupBy("bin_length").agg(
        F.count("*").alias("bins"), F.sum("n").alias("n_tokens"), F.sum(F.col("bin_length") - F.col("n")).alias("unused")
    )
