"""Page-bounded chunks with overlap: a fold over the lines of each staged document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, OVERLAP = 1200, 150
_PAGE = re.compile(r"^##\s+Page\s+(\d+)", re.IGNORECASE | re.ASCII)
_HEADING = re.compile(r"^###?\s+(.+)$", re.ASCII)
_ENDS = re.compile(r"\r\n|\r|\n")
_CONTROL = "".join(map(chr, range(33)))
_NO_BREAK = "\x85\xa0\u2007\u202f"  # no white space in the sense of the overlap
CHUNK_SCHEMA = "chunk_id string, document_name string, page_number int, heading string, content string, character_count int"


@dataclass
class Chunk:
    page: int
    heading: str
    content: str
    size: int


def _tail(buffer: str, overlap: int) -> str:
    """The end of a full buffer that the next chunk begins with: from the next white space on."""
    cut = max(0, len(buffer) - overlap)
    while cut < len(buffer) and (not buffer[cut].isspace() or buffer[cut] in _NO_BREAK):
        cut += 1
    return buffer[cut:].strip(_CONTROL)


def fold(text: str | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Iterator[Chunk]:
    """The chunks of one document. Null and blank texts have none.

    A page mark closes what is there, without overlap; a full buffer closes after the line that fills
    it, as lines are never cut, and hands its tail on. The heading is the latest one at that time.
    A page mark beyond the range of int spoils the document: it has no chunks.
    """
    page, heading, buffer = 1, "General", ""
    lines = _ENDS.split(text or "")
    if lines and not lines[-1]:
        lines.pop()
    if any((m := _PAGE.match(line)) and int(m[1]) > 2**31 - 1 for line in lines):
        return
    for line in lines:
        mark = _PAGE.match(line)
        if mark:
            if buffer.strip(_CONTROL):
                yield Chunk(page, heading, buffer.strip(_CONTROL), len(buffer))
                buffer = ""
            page = int(mark[1])
            continue
        title = _HEADING.match(line)
        if title:
            heading = title[1].strip(_CONTROL)
        buffer += line + "\n"
        if len(buffer) >= size:
            yield Chunk(page, heading, buffer.strip(_CONTROL), len(buffer))
            tail = _tail(buffer, overlap)
            buffer = tail + " " if tail else ""
    if buffer.strip(_CONTROL):
        yield Chunk(page, heading, buffer.strip(_CONTROL), len(buffer))


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of (document_name, text) rows, numbered from 0 within each document, in Arrow batches.

    The fold is narrow: documents stay where they are, nothing is shuffled.
    """
    schema = pa.schema(
        [("chunk_id", pa.string()), ("document_name", pa.string()), ("page_number", pa.int32()), ("heading", pa.string()), ("content", pa.string()), ("character_count", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("document_name").to_pylist(), batch.column("text").to_pylist()):
                for i, c in enumerate(fold(text, size, overlap)):
                    rows.append((f"{name or ''}_chunk_{i}", name, c.page, c.heading, c.content, c.size))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select("document_name", "text").mapInArrow(run, CHUNK_SCHEMA)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """(files, chunks) of a chunk table."""
    return chunks.agg(F.countDistinct("document_name").alias("files"), F.count("*").alias("chunks"))
