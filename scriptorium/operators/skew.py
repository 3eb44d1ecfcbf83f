"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """Join `rows` to `groups`, which has one row per key and the key's number of rows in column `n`.

    The groups above HOT_SHARE of the grouped rows, fewer than 500 by construction whatever the data,
    are broadcast; all others meet their rows in an ordinary shuffle join. A hot key therefore never
    lands in one task. Null keys never match.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    limit = max(1000, int(total * HOT_SHARE))
    hot = groups.where(F.col(n) > limit)
    hot_keys = hot.select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot_keys), keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(n) <= limit), keys, how)
    warm = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), keys, "inner")
    return cold.unionByName(warm)
