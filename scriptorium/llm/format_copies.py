"""Problem 1: copies hidden by white space, letter case, punctuation or the order of fields.

Each text streams through a skip-and-fold table into two 64-bit rolling polynomial hashes; lists of
fields get an order-free sum of their fields' hashes as well. Rows whose hashes collide are compared
symbol by symbol with their group's smallest row, skipping what the table skips. Hashes that collide
by accident are taken apart by an exact key.

Null, empty and short texts (under `min_words` words) are never copies of anything. Ties cannot
occur: a group is represented by its smallest key. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textcore as core
from scriptorium.llm.frames import map_batches, map_text
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

MIN_WORDS = 30
_KEYS = "src_table string, row_id long, n_words int, k1 long, k2 long, f1 long, f2 long"


def _hash_batch(rest: dict[str, list], texts: list[str]) -> dict[str, object]:
    a, b = core.rolling_hashes(texts)
    fa, fb, mask = core.field_hashes(texts)
    codes_words = core.words(texts)[1]
    return {
        "src_table": rest["src_table"],
        "row_id": rest["row_id"],
        "n_words": codes_words.astype(np.int32),
        "k1": core.signed(a),
        "k2": core.signed(b),
        "f1": [int(x) if m else None for x, m in zip(core.signed(fa), mask)],
        "f2": [int(x) if m else None for x, m in zip(core.signed(fb), mask)],
    }


def copy_keys(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(src_table, row_id, n_words, k1, k2, f1, f2): the two hashes of each text, f* null unless a list of fields."""
    keyed = map_text(rows.select("src_table", "row_id", "text"), _KEYS, _hash_batch)
    return keyed.where(F.col("n_words") >= min_words)


def _class_keys(keys: DataFrame) -> DataFrame:
    """One key per class of copies: the fields' key for lists of fields and what equals one of them in order.

    Hot keys are joined apart.
    """
    own = ["src_table", "k1", "k2"]
    listed = (
        keys.groupBy(*own)
        .agg(F.min(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2"))).alias("f"), F.count("*").alias("_n"))
        .where(F.col("f").isNotNull())
    )
    listed = write_table(listed, "copy-lists")
    return join_groups(keys, listed, own, "_n", "left").select(
        "src_table", "row_id", F.coalesce("f.f1", "k1").alias("c1"), F.coalesce("f.f2", "k2").alias("c2")
    )


def _compare(batch) -> dict[str, object]:
    a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
    same = [core.canonical_equal(x or "", y or "") or core.fields_equal(x or "", y or "") for x, y in zip(a, b)]
    exact = [None if s else _exact_key(y or "") for s, y in zip(same, b)]
    return {c: batch.column(c) for c in ("src_table", "row_a", "row_b")} | {"same": same, "exact": exact}


def _exact_key(text: str) -> str:
    parts = core.fields_of(text) or [text]
    codes, ends = core.folded(parts)
    canon = sorted(x[x != 0].tobytes() for x in np.split(codes, ends[:-1]))
    return hashlib.sha256(b"\0\0\0\0".join(canon)).hexdigest()


def find_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(src_table, row_a, row_b): each copy `row_b` with the smallest key `row_a` among its copies."""
    keys = write_table(_class_keys(write_table(copy_keys(rows, min_words), "copy-hashes")), "copy-keys")
    groups = (
        keys.groupBy("src_table", "c1", "c2")
        .agg(F.min("row_id").alias("row_a"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    groups = write_table(groups, "copy-groups")
    pairs = (
        join_groups(keys, groups, ["src_table", "c1", "c2"], "n")
        .where(F.col("row_id") != F.col("row_a"))
        .select("src_table", "row_a", F.col("row_id").alias("row_b"), "n")
    )
    # A representative's text is needed by each of its copies: hot ones are spread over salts.
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / 5000)).cast("int")
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("row_b"), salts).cast("int"))
    texts = rows.select("src_table", "row_id", "text")
    left = groups.select(
        "src_table", F.col("row_a").alias("row_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    text_a = left.join(texts, ["src_table", "row_id"]).select(
        "src_table", F.col("row_id").alias("row_a"), "salt", F.col("text").alias("text_a")
    )
    text_b = pairs.join(
        texts.select("src_table", F.col("row_id").alias("row_b"), F.col("text").alias("text_b")), ["src_table", "row_b"]
    )
    both = text_b.join(text_a, ["src_table", "row_a", "salt"]).select(
        "src_table", "row_a", "row_b", "text_a", "text_b"
    )
    checked = write_table(
        map_batches(both, "src_table string, row_a long, row_b long, same boolean, exact string", _compare),
        "copy-checked",
    )
    apart = checked.where(~F.col("same"))
    regrouped = (
        apart.join(
            apart.groupBy("src_table", "row_a", "exact").agg(F.min("row_b").alias("least")),
            ["src_table", "row_a", "exact"],
        )
        .where(F.col("row_b") != F.col("least"))
        .select("src_table", F.col("least").alias("row_a"), "row_b")
    )
    return checked.where("same").select("src_table", "row_a", "row_b").unionByName(regrouped)


def collapse(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(src_table, row_id, copies): one record for each class of copies, the smallest key, with its size.

    Rows that are no copies, among them null, empty and short texts, come out with 1.
    """
    found = write_table(find_copies(rows, min_words), "copies")
    counts = found.groupBy("src_table", F.col("row_a").alias("row_id")).agg(F.count("*").alias("more"))
    kept = rows.select("src_table", "row_id").join(
        found.select("src_table", F.col("row_b").alias("row_id")), ["src_table", "row_id"], "left_anti"
    )
    return kept.join(counts, ["src_table", "row_id"], "left").select(
        "src_table", "row_id", (F.coalesce("more", F.lit(0)) + 1).cast("long").alias("copies")
    )
