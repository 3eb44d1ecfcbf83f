"""Line structure of page text: classification, headings, table islands, Markdown pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from scriptorium.functions import text as T

#: Forms of lines.
LEGAL = r"^(\d+(\.\d+)+)\s+(.+)$"
NUMBERED = r"^(\d+\.)\s+(.+)$"
BULLET = r"^[•\-*–—]\s+(.+)$"
WIDE_GAP = r"\s{3,}"
HEADER_WORDS = ("Order", "Chapter", "Section", "कार्यालय")
BLANK_PAGE = "*(blank page)*"


def is_heading(line: Column) -> Column:
    """Short, without closing punctuation, and in capitals or led by a header word."""
    caps = (F.upper(line) == line) & line.rlike("[A-Z]")
    led = line.startswith(HEADER_WORDS[0])
    for word in HEADER_WORDS[1:]:
        led = led | line.startswith(word)
    return F.length(line).between(5, 80) & ~line.rlike(r"[.,;]$") & (caps | led)


def line_kind(line: Column) -> Column:
    """blank, table, legal, numbered, bullet, heading or paragraph; the first that fits a trimmed line."""
    return (
        F.when(line == "", "blank")
        .when(line.rlike(WIDE_GAP) & (F.length(line) > 10), "table")
        .when(line.rlike(LEGAL), "legal")
        .when(line.rlike(NUMBERED), "numbered")
        .when(line.rlike(BULLET), "bullet")
        .when(is_heading(line), "heading")
        .otherwise("paragraph")
    )


def line_markdown(line: Column, kind: Column) -> Column:
    """The Markdown of a line of the given kind; table lines are left to `tables`."""
    return (
        F.when(kind == "legal", F.concat(F.lit("### "), F.regexp_replace(line, LEGAL, "$1 $3")))
        .when(kind == "numbered", F.regexp_replace(line, NUMBERED, "$1 $2"))
        .when(kind == "bullet", F.concat(F.lit("- "), F.regexp_replace(line, BULLET, "$1")))
        .when(kind == "heading", F.concat(F.lit("### "), line))
        .otherwise(line)
    )


def classify_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, kind, markdown): one row for each line of each text; null texts give one blank line."""
    lines = pages.select(key, F.posexplode(F.split(T.text_of(F.col(text)), r"\r?\n")).alias("line_no", "raw"))
    lines = lines.select(key, "line_no", T.trim(F.col("raw")).alias("line")).withColumn("kind", line_kind(F.col("line")))
    return lines.withColumn("markdown", line_markdown(F.col("line"), F.col("kind")))


def tables(lines: DataFrame, key: str) -> DataFrame:
    """(key, first_line, n_rows, n_cols): runs of table lines (gaps and islands within each text)."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("island", F.sum((F.col("kind") != "table").cast("int")).over(order))
    return (
        marked.where(F.col("kind") == "table")
        .groupBy(key, "island")
        .agg(
            F.min("line_no").alias("first_line"),
            F.count("*").alias("n_rows"),
            F.max(F.size(F.split("line", WIDE_GAP))).alias("n_cols"),
        )
        .drop("island")
    )


def cell(text: str) -> str:
    return text.replace("|", "\\|").strip()


def page_markdown(text: str | None) -> str:
    """The Markdown of one page: classified lines, with runs of table lines as pipe tables."""
    if not (text or "").strip():
        return BLANK_PAGE + "\n"
    out: list[str] = []
    rows: list[list[str]] = []

    def close() -> None:
        if rows:
            width = max(map(len, rows))
            head = [cell(rows[0][i]) if i < len(rows[0]) else f"Col {i + 1}" for i in range(width)]
            out.append("|" + "".join(f" {c} |" for c in head))
            out.append("|" + "---|" * width)
            out.extend("|" + "".join(f" {cell(r[i]) if i < len(r) else ''} |" for i in range(width)) for r in rows[1:])
            out.append("")
            rows.clear()

    for raw in re.split(r"\r?\n", text or ""):
        line = raw.strip(T.TRIMMED)
        cells = re.split(WIDE_GAP, line, flags=re.ASCII)
        if line and len(cells) >= 2 and len(line) > 10:
            rows.append(cells)
            continue
        close()
        if m := re.match(LEGAL, line, re.ASCII):
            out.append(f"### {m[1]} {m[3]}")
        elif m := re.match(NUMBERED, line, re.ASCII):
            out.append(f"{m[1]} {m[2]}")
        elif m := re.match(BULLET, line, re.ASCII):
            out.append(f"- {m[1]}")
        elif 5 <= len(line) <= 80 and line[-1] not in ".,;" and (
            (line.upper() == line and re.search("[A-Z]", line)) or line.startswith(HEADER_WORDS)
        ):
            out.append(f"### {line}")
        else:
            out.append(line)
    close()
    return "\n".join(out) + "\n"


@F.pandas_udf(types.StringType())
def to_markdown(pages: pd.Series) -> pd.Series:
    """`page_markdown` in Arrow batches."""
    return pages.map(page_markdown)


def stage_documents(pages: DataFrame, document: str = "document_name", page: str = "page_number", text: str = "page_text") -> DataFrame:
    """(document_name, text): each document's pages as one staged Markdown text with its preamble.

    A document is the unit of the staged form, so its pages meet in one row, as in a file.
    """
    marked = pages.select(
        F.col(document).alias("document_name"),
        F.coalesce(F.col(page), F.lit(1)).alias("page"),
        F.concat(F.lit("## Page "), F.coalesce(F.col(page), F.lit(1)).cast("string"), F.lit("\n\n"), to_markdown(F.col(text))).alias("md"),
    )
    staged = marked.groupBy("document_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda x: x["md"]), "\n").alias("body"),
        F.count("*").alias("n_pages"),
    )
    return staged.select("document_name", F.concat(preamble(F.col("document_name"), F.col("n_pages")), F.col("body")).alias("text"))


def preamble(name: Column, n_pages: Column) -> Column:
    """The header lines of a staged document."""
    return F.concat(
        F.lit("# Document: "), T.text_of(name), F.lit("\n> Source: "), T.text_of(name), F.lit("\n> Total Pages: "), n_pages.cast("string"), F.lit("\n\n")
    )


def carry_page_and_heading(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, page, heading): each line with the page and the heading it stands under.

    Before the first mark the page is 1 and the heading `General`; a heading outlives its page.
    """
    lines = documents.select(key, F.posexplode(T.lines_of(F.col(text))).alias("line_no", "line"))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"(?i)^##\s+Page\s+(\d+)", 1)
    page = F.when(mark != "", mark.try_cast("int"))
    title = F.when((mark == "") & F.col("line").rlike(r"^###?\s+.+$"), T.trim(F.regexp_extract("line", r"^###?\s+(.+)$", 1)))
    return lines.select(
        key,
        "line_no",
        "line",
        F.coalesce(F.last(page, ignorenulls=True).over(so_far), F.lit(1)).alias("page"),
        F.coalesce(F.last(title, ignorenulls=True).over(so_far), F.lit("General")).alias("heading"),
    )
