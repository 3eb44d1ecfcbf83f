"""Frames the operators share: the text tables, and batches of bounded size for Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import table

#: Code points handled at once in an Arrow function; bounds its memory whatever the texts' lengths.
BATCH_CHARS = 1_000_000


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, text) of chunk contents and vector texts, every row of both tables."""
    chunks = table(spark, sf_dir, "rag_chunks").select(
        F.lit("rag_chunks").alias("src_table"), F.col("chunk_row").alias("row_id"), F.col("content").alias("text")
    )
    vectors = table(spark, sf_dir, "vector_documents").select(
        F.lit("vector_documents").alias("src_table"), F.col("vec_row").alias("row_id"), "text"
    )
    return chunks.unionByName(vectors)


def slices(texts: list[str], budget: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive slices of at most `budget` characters in all, or of one text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > budget:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def map_text(
    df: DataFrame,
    schema: str | T.StructType,
    fn: Callable[[dict[str, list], list[str]], dict[str, object]],
    text: str = "text",
    chars: int = BATCH_CHARS,
) -> DataFrame:
    """Apply `fn` to batches of rows in Arrow form.

    `fn` gets the other columns as lists (by name) and the texts (null as ''), and returns the
    columns of `schema`; rows may be dropped or added. chars: code points handled at once.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for part in slices(texts, chars):
                length = part.stop - part.start
                rest = {c: batch.column(c).slice(part.start, length).to_pylist() for c in others}
                out = fn(rest, texts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, target)


def map_batches(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, object]]
) -> DataFrame:
    """Apply `fn` to whole Arrow batches; it returns the columns of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


#: Bits of the set that marks wanted rows; its size doesn't depend on the data.
ROW_BITS = 23


def likely_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may occur in `wanted`, without a shuffle: all that do, and some that share a bit with one.

    Makes the join that follows small; where more rows are wanted than there are bits it keeps all.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << ROW_BITS)).cast("int")
    hit = wanted.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()  # at most 2 ** ROW_BITS numbers
    marks = np.zeros(1 << ROW_BITS, bool)
    marks[hit] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            good = marks[batch.column("_bit").to_numpy()]
            if good.any():
                yield batch.filter(pa.array(good)).drop_columns(["_bit"])

    return rows.withColumn("_bit", bit).mapInArrow(keep, rows.schema)
