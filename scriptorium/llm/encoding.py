"""Problem 8: byte-level BPE encoding of the whole corpus with a public vocabulary.

A word's bytes form a doubly linked list of symbols; adjacent pairs wait in a priority queue by the
rank of their merger, and entries whose symbols have changed since are skipped. Words are kept in a
dictionary of bounded size, as most words recur.

Null and empty texts give an empty list of ids. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scriptorium.llm.frames import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for ASCII texts; there the re module is several times faster than full Unicode classes.
_ASCII = (
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
#: A stretch without ASCII space that holds other than ASCII characters, with the one space before it.
#: No word of PATTERN crosses its ends, unless there is white space beyond ASCII.
_OTHER = re.compile(r"((?:\A|[ \t-\r])[^ \t-\r\x80-\U0010ffff]*+[^\x00-\x7f][^ \t-\r]*)")
_ODD_SPACE = re.compile("[\x85\xa0  -     　]")
WORDS_KEPT = 500_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file as a dictionary from token bytes to ids, which are the merge ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: always merge the adjacent pair of lowest rank, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    symbols: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, 2))
    heapq.heapify(queue)
    while queue:
        rank, left, size = heapq.heappop(queue)
        a = symbols[left]
        right = after[left]
        if a is None or right >= n:
            continue
        b = symbols[right]
        if len(a) + len(b) != size or ranks.get(a + b) != rank:  # type: ignore[arg-type, operator]
            continue  # stale: one of the two has been merged since
        joined = a + b  # type: ignore[operator]
        symbols[left], symbols[right] = joined, None
        after[left] = end = after[right]
        if end < n:
            before[end] = left
            longer = joined + symbols[end]  # type: ignore[operator]
            new = ranks.get(longer)
            if new is not None:
                heapq.heappush(queue, (new, left, len(longer)))
        start = before[left]
        if start >= 0:
            longer = symbols[start] + joined  # type: ignore[operator]
            new = ranks.get(longer)
            if new is not None:
                heapq.heappush(queue, (new, start, len(longer)))
    return [ranks[s] for s in symbols if s is not None]


class Encoder:
    """Encodes texts with one vocabulary; keeps the words it has met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words: dict[str, list[int]] = {}
        self._ascii = re.compile(_ASCII).findall
        self._any = regex.compile(PATTERN).findall

    def _new(self, word: str, several: bool) -> list[int]:
        parts = self._any(word) if several else [word]
        ids = [i for part in parts for i in merge_word(part.encode("utf-8", "replace"), self.ranks)]
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.words, []
        if text.isascii():
            stretches = [text]
        elif _ODD_SPACE.search(text):
            return [i for word in self._any(text) for i in known.get(word) or self._new(word, False)]
        else:
            stretches = _OTHER.split(text)
        for k, stretch in enumerate(stretches):
            if k % 2:
                out += known.get(stretch) or self._new(stretch, True)
            elif stretch:
                for word in self._ascii(stretch):
                    out += known.get(word) or self._new(word, False)
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids: their vocabulary strings, concatenated."""
    back = {i: token for token, i in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8")


def _encoded(df: DataFrame, key: str, text: str, only_counts: bool, vocabulary: str) -> DataFrame:
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # of the vocabulary's size, whatever the corpus
    kind = pa.int64() if only_counts else pa.list_(pa.int32())
    name = "n_tokens" if only_counts else "ids"
    schema = pa.schema([(key, pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for part in slices(texts):
                keys = batch.column(key).slice(part.start, part.stop - part.start)
                if only_counts:
                    values = pa.array([encoder.count(t) for t in texts[part]], pa.int64())
                else:
                    flat, ends = array("i"), [0]
                    for t in texts[part]:
                        flat.extend(encoder.encode(t))
                        ends.append(len(flat))
                    values = pa.ListArray.from_arrays(
                        pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())
                    )
                yield pa.RecordBatch.from_arrays([keys, values], schema=schema)

    return df.select(key, text).mapInArrow(run, f"{key} long, {name} {'long' if only_counts else 'array<int>'}")


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text."""
    return _encoded(df, key, text, False, vocabulary)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of ids of each row's text."""
    return _encoded(df, key, text, True, vocabulary)
