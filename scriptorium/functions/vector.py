"""Vectors: hashed term-frequency embeddings, similarity and scores."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from scriptorium.functions import text as T
from scriptorium.functions.predicates import INDEX_MARKS, NOTICE_MARKS, any_of

DIMS = 128
LEXICAL_PENALTY, VECTOR_PENALTY = 0.05, 0.1
PHRASE_BONUS = 0.3


def string_hash(token: str) -> int:
    """The 32-bit string hash with factor 31, signed."""
    h = 0
    for ch in token:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def term_counts(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Counts of the text's ASCII words by hash bucket."""
    out = np.zeros(DIMS, np.int32)
    for token in re.split("[^a-z0-9]+", (text or "").lower()):
        if token:
            bucket = known.get(token)
            if bucket is None:
                h = string_hash(token)
                bucket = known[token] = abs(h) % DIMS if h != -(1 << 31) else 0
            out[bucket] += 1
    return out


def embed(text: str | None, known: dict[str, int] | None = None) -> np.ndarray:
    """Counts of the text's ASCII words by hash bucket, of length one; zero without words."""
    out = term_counts(text, {} if known is None else known).astype(np.float32)
    norm = np.sqrt(np.float64(out @ out))
    return out / np.float32(norm) if norm > 0 else out


@F.pandas_udf(types.ArrayType(types.IntegerType()))
def term_histogram(texts: pd.Series) -> pd.Series:
    """The counts behind the embedding of each text."""
    known: dict[str, int] = {}
    return pd.Series([term_counts(t, known) for t in texts])


@F.pandas_udf(types.ArrayType(types.FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """The embedding of each text, in Arrow batches; words recur, so their buckets are kept for the batch."""
    known: dict[str, int] = {}
    return pd.Series([embed(t, known) for t in texts])


def hash_embedding_builtin(c: Column) -> Column:
    """The same without Python: interpreted higher-order functions, slower, for sessions without Python workers."""
    tokens = F.filter(F.split(F.lower(T.text_of(c)), "[^a-z0-9]+"), lambda t: t != "")
    raw = F.transform(
        tokens,
        lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("bigint"), lambda a, ch: F.pmod(a * 31 + F.ascii(ch), F.lit(1 << 32))),
    )
    buckets = F.transform(raw, lambda h: F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % DIMS)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double")
    )
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(tokens) == 0, F.array_repeat(F.lit(0.0).cast("float"), DIMS)).otherwise(
        F.transform(counts, lambda x: (x / norm).cast("float"))
    )


def similarity(a: Column, b: Column) -> Column:
    """The dot product; 0 for null or for unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(dot, F.lit(0.0))).otherwise(0.0)


def distance_score(distance: Column) -> Column:
    """The score of a squared distance between unit vectors: 1 - d / 2, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance / 2.0))


def lexical_score(query: str, document: Column, heading: Column, text: Column) -> Column:
    """The share of the query's keywords that occur in document, heading or text; more for the whole query."""
    low = query.lower()
    words = [w for w in re.split("[^a-z0-9]+", low) if len(w) > 2 and w not in T.STOP_WORDS]
    if not words:
        return F.lit(0.0)
    target = F.lower(F.concat_ws(" ", T.text_of(document), T.text_of(heading), T.text_of(text)))
    hits = sum((target.contains(w).cast("int") for w in words), F.lit(0))
    share = hits.cast("double") / len(words)
    return F.when(target.contains(low.strip()), F.least(F.lit(1.0), share + PHRASE_BONUS)).otherwise(share)


def penalties(text: Column) -> Column:
    """How many of the three rules against preambles, indexes and short notices a text meets."""
    low, size = F.lower(T.text_of(text)), F.length(T.text_of(text))
    rules = (
        low.startswith("# document:") & (size < 280),
        any_of(low, (*INDEX_MARKS, "table of contents")),
        any_of(low, NOTICE_MARKS) & (size < 220),
    )
    return sum((r.cast("int") for r in rules), F.lit(0))


def hybrid_score(vector: Column, lexical: Column, rules: Column) -> Column:
    """Vector and lexical score combined, both lowered by the penalty rules."""
    l = lexical * F.pow(F.lit(LEXICAL_PENALTY), rules)  # noqa: E741
    v = vector * F.pow(F.lit(VECTOR_PENALTY), rules)
    return F.when(l > 0, 0.35 * v + 0.65 * l).otherwise(0.75 * v)
