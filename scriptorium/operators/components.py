"""Connected components by alternating large and small stars; nothing is collected, lineage is cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import write_table


def _star(edges: DataFrame, part: str, large: bool) -> DataFrame:
    """Connect each node's greater (large) or smaller (small) neighbours with its least neighbour."""
    both = edges.unionByName(edges.select(part, F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy(part, "a").agg(F.min("b").alias("_m")).select(part, "a", F.least("a", "_m").alias("_m"))
    joined = both.join(least, [part, "a"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(part, F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(part, F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select(part, "a", F.col("_m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, part: str, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(part, node, component): for each node of an edge the least node of its component, within each part.

    The number of rounds grows with the logarithm of the number of nodes; should `most_rounds` not
    do, an error is raised rather than a wrong result given. Isolated nodes aren't listed.
    """
    now = write_table(edges.select(part, F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        now = write_table(_star(_star(now, part, True), part, False), "components")
        mark = now.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({part}, a, b))")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(part, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(part, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
