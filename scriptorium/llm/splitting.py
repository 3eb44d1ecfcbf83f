"""Problem 5: cutting oversized texts at natural boundaries, with overlap.

Every position of a text gets the strength of the boundary before it. A sparse table answers which
position is strongest within the window a cut may lie in, the rightmost of equals. The next piece
begins about `overlap` characters before the cut, at the strongest boundary near there.

Null, empty and short texts give no pieces (`split_text` returns them whole). A text without any
boundary is cut at the limit. Lengths are Unicode code points; a combining mark is never parted
from its base unless nothing else is possible. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import map_text

LIMIT = 1600
OVERLAP = 150
SLACK = 30  # a piece begins OVERLAP - SLACK to OVERLAP + SLACK characters before the last cut
LEAST = 800  # a cut leaves a piece at least this long
#: Boundary strengths, from strong to weak; a cut lies at the end of the match.
_STRENGTHS = (
    (7, re.compile(r"\n(?=#{1,6}\s)")),
    (6, re.compile(r"(?:\r?\n[ \t]*){2,}|\f")),
    (5, re.compile(r"[.!?।][\"'”’»)\]]*\s+")),
    (4, re.compile(r"\r\n|\n|\r")),
    (3, re.compile(r"[;:,][\"'”’»)\]]*\s+|\s[–—-]\s")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"[^\w\s]")),
)
_HIGH = re.compile("[\u0300-\U0010ffff]")  # all combining marks are among these


def strengths(text: str) -> np.ndarray:
    """For each position 0..len(text), how natural a cut before it is; 0: none."""
    out = np.zeros(len(text) + 1, np.int64)
    for value, pattern in reversed(_STRENGTHS):
        for match in pattern.finditer(text):
            out[match.end()] = max(out[match.end()], value)
    if not text.isascii():
        for match in _HIGH.finditer(text):
            ch = match.group()
            if unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Me") or ch == "\u200d":
                out[match.start()] = -1
    return out


class RangeMaximum:
    """A sparse table: the position of the greatest value in any range, the rightmost of equals."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        n = len(values)
        level = values.astype(np.int64) * (n + 1) + np.arange(n)  # the position breaks ties rightward
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= min(widest, n):
            level = np.maximum(level[: n - 2 * width + 1], level[width : n - width + 1])
            self.levels.append(level)
            width *= 2

    def argmax(self, low: int, high: int) -> int:
        """The best position in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        best = max(self.levels[k][low], self.levels[k][high - (1 << k) + 1])
        return int(best % (self.n + 1))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece when it is within the limit."""
    if len(text) <= limit:
        return [(0, len(text))]
    least = max(1, min(LEAST, limit // 2))
    overlap = min(overlap, least - 1)
    slack = min(SLACK, overlap)
    table = RangeMaximum(strengths(text), limit + 1)
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = table.argmax(start + least, start + limit)
        pieces.append((start, cut))
        start = table.argmax(max(start + 1, cut - overlap - slack), min(cut, cut - overlap + slack)) if overlap else cut
    pieces.append((start, len(text)))
    return pieces


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_row, chunk_id, document_name, page_number, piece_no, n_pieces, start, content, character_count).

    Pieces, numbered from 0, of each chunk whose content exceeds the limit, whatever its recorded length.
    """
    schema = (
        "chunk_row long, chunk_id string, document_name string, page_number int, piece_no int, n_pieces int, "
        "start int, content string, character_count int"
    )
    names = ["chunk_row", "chunk_id", "document_name", "page_number"]

    def cut(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*names, "piece_no", "n_pieces", "start", "content", "character_count")}
        for i, text in enumerate(texts):
            pieces = split_text(text, limit, overlap)
            for k, (a, b) in enumerate(pieces):
                for n in names:
                    out[n].append(rest[n][i])
                for n, v in (("piece_no", k), ("n_pieces", len(pieces)), ("start", a), ("content", text[a:b]), ("character_count", b - a)):
                    out[n].append(v)
        return out

    long = chunks.where(F.length("content") > limit)
    return map_text(long.select(*names, "content"), schema, cut, text="content")
