"""Sinks: staged Markdown, chunk and vector records, batches to an external index, the ledger."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import ledger as L


def file_name_of(document: str) -> str:
    """The file name of a staged document: what isn't safe in a name is percent-encoded, a leading dot or underscore too."""
    name = quote(document, safe=" ()")
    return (f"%{ord(name[0]):02X}" + name[1:] if name[0] in "._ " else name) + ".md"


def write_markdown(documents: DataFrame, path: str) -> int:
    """Staged documents as one Markdown file each, named by the document; the number of files.

    The executors write the files themselves, to whatever file system the path names; a task that is
    tried again writes the same files again. Documents without a name or a text are left out, of
    several with one name any one stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        files.create_dir(base, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column("document_name").to_pylist(), batch.column("text").to_pylist()):
                with files.open_output_stream(f"{base}/{file_name_of(name)}") as out:
                    out.write(text.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    named = documents.select("document_name", "text").where("document_name <> '' and text <> ''")
    return named.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; a failed job leaves nothing behind."""
    chunks.select(
        F.col("chunk_id").alias("chunkId"), F.col("document_name").alias("documentName"), F.col("page_number").alias("pageNumber"),
        "heading", "content", F.col("character_count").alias("characterCount"),
    ).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vector rows as JSON lines, duplicates included."""
    vectors.select(
        "id", F.col("document_name").alias("documentName"), F.col("page_number").alias("pageNumber"), "heading", "text", "embedding", "metadata"
    ).write.mode("overwrite").json(path)


def add_to_index(vectors: DataFrame, send: Callable[[list[dict]], None], batch: int = 64, attempts: int = 3, pause: float = 0.1) -> DataFrame:
    """(sent, failed): rows handed to an external index in batches, with doubling pauses between attempts.

    A batch that fails to the last is counted and doesn't fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = failed = 0
        for rows in batches:
            listed = rows.to_pylist()
            for at in range(0, len(listed), batch):
                part = listed[at : at + batch]
                for attempt in range(attempts):
                    try:
                        send(part)
                        sent += len(part)
                        break
                    except Exception:  # noqa: BLE001 - the index may raise anything; the batch is tried again
                        if attempt + 1 == attempts:
                            failed += len(part)
                        else:
                            time.sleep(pause * 2**attempt)
        yield pa.RecordBatch.from_pydict({"sent": [sent], "failed": [failed]})

    return vectors.mapInArrow(run, "sent long, failed long").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


def save_ledger(ledger: DataFrame, updates: DataFrame, path: str) -> None:
    """Write the ledger with the updates applied to a new place; the old one stays readable until then."""
    L.upsert(ledger, updates).write.mode("overwrite").parquet(path)
