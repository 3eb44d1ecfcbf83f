"""Sources: files to parse, staged documents, chunk and vector records, landing folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T

CHUNKS = "chunkId string, documentName string, pageNumber int, heading string, content string, characterCount int"
VECTORS = (
    "id string, documentName string, pageNumber int, heading string, text string, embedding array<float>, "
    "metadata struct<document:string,page:int,heading:string,sources:string,deduplicated:boolean>"
)
LARGE_FILE = 50_000_000


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, file_name, length, modified, checksum): all files of a suffix, in either case, in all subfolders.

    Files without a byte are left out, as the file source lists none.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"), T.file_checksum(F.col("content")).alias("checksum")
    )


def inspect_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, length, megabytes, strategy): sizes, without reading contents."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path", "length", F.round(F.col("length") / (1024.0 * 1024.0), 1).alias("megabytes"),
        F.when(F.col("length") > LARGE_FILE, "PAGE_BATCH_STREAMING").otherwise("STANDARD_STREAMING").alias("strategy"),
    )


def read_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> tuple[DataFrame, DataFrame]:
    """((document_name, page_number, page_text), (path, error)): the pages of binary files (path, content), and what failed.

    `extract` turns a file's bytes into page texts; no PDF library is assumed. A file that fails, or
    has no pages, goes to the second frame and spoils no other.
    """
    schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("page_text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    pages = extract(content or b"")
                    if not pages:
                        raise ValueError("no pages")
                    rows = [(path, i + 1, p, None) for i, p in enumerate(pages)]
                except Exception as error:  # noqa: BLE001 - whatever the extractor raises concerns this file only
                    rows = [(path, None, None, f"{type(error).__name__}: {error}"[:4000])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    rows = files.select("path", "content").mapInArrow(run, "path string, page_number int, page_text string, error string")
    name = T.base_name(F.element_at(F.split("path", "/"), -1))
    return rows.where("error is null").select(name.alias("document_name"), "page_number", "page_text"), rows.where("error is not null").select("path", "error")


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """(document_name, text): the Markdown files of a folder, as `writers.write_markdown` leaves them."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    # the path is encoded as a URI, and names in it by the writer
    name = F.url_decode(F.replace(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)), F.lit("+"), F.lit("%2B")))
    return files.select(T.base_name(name).alias("document_name"), F.col("value").alias("text"))


def read_chunks(spark: SparkSession, path: str, files: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of JSON lines; missing fields are empty or 0, malformed lines are kept apart."""
    lines = spark.read.option("pathGlobFilter", files).text(path).where(~T.is_blank(F.col("value")))
    parsed = F.from_json("value", CHUNKS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(parsed.alias("r"), "value").select("r.*", "value")
    good = rows.where("_bad is null").select(
        T.text_of(F.col("chunkId")).alias("chunk_id"), T.text_of(F.col("documentName")).alias("document_name"), F.coalesce("pageNumber", F.lit(0)).alias("page_number"),
        T.text_of(F.col("heading")).alias("heading"), T.text_of(F.col("content")).alias("content"), F.coalesce("characterCount", F.lit(0)).alias("character_count"),
    )
    return good, rows.where("_bad is not null").select(F.col("value").alias("line"))


def read_vectors(spark: SparkSession, path: str, files: str = "*.jsonl") -> DataFrame:
    """Vector rows of JSON lines; rows without an embedding are left out."""
    rows = spark.read.schema(VECTORS).option("pathGlobFilter", files).json(path)
    return rows.where("embedding is not null").select(
        "id", F.col("documentName").alias("document_name"), F.col("pageNumber").alias("page_number"), "heading", "text", "embedding", "metadata"
    )


def count_lines(spark: SparkSession, path: str, files: str = "*.jsonl") -> int:
    """All lines of the vector files, blank ones and duplicates included."""
    return spark.read.option("pathGlobFilter", files).text(path).count()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def landing_stream(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """A stream of the files that arrive in a landing folder, each once."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
