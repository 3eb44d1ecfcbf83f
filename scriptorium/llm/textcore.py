"""Vectorised text kernels: skip-and-fold tables, rolling hashes, word shingles, min-hash signatures.

All functions take a list of strings (a batch) and work on one flat code point array, so that no
Python loop runs per character. Null texts must be passed as ''.
"""

from __future__ import annotations

import re
import sys

import numpy as np

U64 = np.uint64
_PLANES = 0x20000  # beyond these two planes a code point is its own fold
_cache: dict[str, object] = {}
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_A
    x = x ^ (x >> U64(27))
    x = x * _MIX_B
    return x ^ (x >> U64(31))


def _tables() -> tuple[np.ndarray, dict[int, str], np.ndarray]:
    """The fold table (0: skipped), the folds of several characters, and where those apply."""
    if "fold" not in _cache:
        fold = np.zeros(_PLANES, np.uint32)
        several: dict[int, str] = {}
        for cp in range(1, _PLANES):
            ch = chr(cp)
            if ch.isalnum():
                low = "".join(c for c in ch.casefold() if c.isalnum()) or ch
                fold[cp] = ord(low[0])
                if len(low) > 1:
                    several[cp] = low
        flag = np.zeros(_PLANES, bool)
        flag[list(several)] = True
        _cache["fold"] = (fold, several, flag)
    return _cache["fold"]  # type: ignore[return-value]


def _several_pattern() -> re.Pattern[str]:
    if "pattern" not in _cache:
        _cache["pattern"] = re.compile("[" + re.escape("".join(map(chr, _tables()[1]))) + "]")
    return _cache["pattern"]  # type: ignore[return-value]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return codes, ends


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points (0 where skipped) of all texts in a row, and where each text ends."""
    fold, several, flag = _tables()
    codes, ends = _codes(texts)
    if codes.size and codes.max() > 127:
        high = np.flatnonzero(codes > 127)
        high = high[flag[np.minimum(codes[high], _PLANES - 1)]]
        if high.size:
            texts = list(texts)
            for i in np.unique(np.searchsorted(ends, high, side="right")).tolist():
                texts[i] = _several_pattern().sub(lambda m: several[ord(m.group())], texts[i])
            codes, ends = _codes(texts)
    if not codes.size or codes.max() < _PLANES:
        return fold[codes], ends
    low = codes < _PLANES
    out = fold[np.where(low, codes, 0)]
    rest = np.flatnonzero(~low)
    out[rest] = [c if chr(c).isalnum() else 0 for c in codes[rest].tolist()]
    return out, ends


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    """mix(code + salt) of each code point, looked up where the table has it."""
    if codes.size and codes.max() >= _PLANES:
        return mix(codes.astype(U64) + U64(salt))
    table = _cache.get(f"mixed {salt}")
    if table is None:
        table = _cache[f"mixed {salt}"] = mix(np.arange(_PLANES, dtype=U64) + U64(salt))
    return table[codes]  # type: ignore[index]


def _powers(base: int, n: int) -> np.ndarray:
    known = _cache.get(base)
    if known is None or len(known) < n:  # type: ignore[arg-type]
        steps = np.full(max(n, 4096), base, U64)
        steps[0] = 1
        known = _cache[base] = np.cumprod(steps)  # wraps modulo 2^64
    return known[:n]  # type: ignore[index]


def _segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], modulo 2^64; empty segments give 0."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def rolling_hashes(texts: list[str], fold: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit polynomial hashes of each text's letters and digits, case folded.

    The code points stream through the skip-and-fold table in place: a skipped one weighs nothing, a
    kept one by its rank among the kept. No string of the kept symbols is ever put together. fold:
    what `folded` gives for the texts, where it is known.
    """
    codes, ends = folded(texts) if fold is None else fold
    at = np.flatnonzero(codes)
    ends = np.searchsorted(at, ends)  # among the kept
    starts = np.concatenate(([0], ends[:-1])) if len(texts) else ends
    lengths = ends - starts
    position = np.arange(at.size) - np.repeat(starts, lengths)
    symbols = _mixed(codes[at], 0x9E3779B97F4A7C15)
    most = int(lengths.max()) if len(lengths) else 0
    out = []
    for base in (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1):
        weighted = _powers(base, most + 1)[position]
        np.multiply(weighted, symbols, out=weighted)
        out.append(mix(_segment_sums(weighted, starts, ends) + lengths.astype(U64)))
    return out[0], out[1]


_STEP = 4096


def _kept(text: str, at: int) -> tuple[np.ndarray, int]:
    """The folded symbols of the next stretch of a text that has any, and where the one after it begins."""
    while at < len(text):
        codes, _ = folded([text[at : at + _STEP]])
        at += _STEP
        codes = codes[codes != 0]
        if codes.size:
            return codes, at
    return np.zeros(0, np.uint32), at


def canonical_equal(a: str, b: str) -> bool:
    """Whether two texts agree in their letters and digits, case folded.

    Two pointers run over the texts, each past what the table skips, a stretch at a time; the first
    difference ends the comparison, and no text is folded as a whole.
    """
    at_a = at_b = 0
    left = right = np.zeros(0, np.uint32)
    while True:
        if not left.size:
            left, at_a = _kept(a, at_a)
        if not right.size:
            right, at_b = _kept(b, at_b)
        n = min(left.size, right.size)
        if not n:
            return left.size == right.size
        if not np.array_equal(left[:n], right[:n]):
            return False
        left, right = left[n:], right[n:]


_FIELD_BREAK = re.compile(r"[\r\n;|]+")


def fields_of(text: str) -> list[str] | None:
    """The fields of a text that is made of at least four fields and nothing else, else None."""
    if text.count(":") < 4:
        return None
    parts = [p for p in map(str.strip, _FIELD_BREAK.split(text)) if p]
    if len(parts) < 4:
        return None
    for part in parts:
        label, colon, value = part.partition(":")
        if not colon or ":" in value or not label.strip() or not value.strip():
            return None
    return parts


def field_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order-free hashes of texts that are lists of fields, and a mask of which texts are."""
    a, b, mask = np.zeros(len(texts), U64), np.zeros(len(texts), U64), np.zeros(len(texts), bool)
    flat, owner = [], []
    for i, text in enumerate(texts):
        parts = fields_of(text)
        if parts:
            mask[i] = True
            flat += parts
            owner += [i] * len(parts)
    if flat:
        ha, hb = rolling_hashes(flat)
        np.add.at(a, owner, mix(ha ^ hb))
        np.add.at(b, owner, mix(hb + (ha << U64(1))))
    return a, b, mask


def fields_equal(a: str, b: str) -> bool:
    """Whether both texts are lists of fields and hold the same fields in whatever order."""
    fa, fb = fields_of(a), fields_of(b)
    if not fa or not fb or len(fa) != len(fb):
        return False

    def keys(parts: list[str]) -> list[bytes]:
        codes, ends = folded(parts)
        return sorted(x[x != 0].tobytes() for x in np.split(codes, ends[:-1]))

    return keys(fa) == keys(fb)


def words(texts: list[str], fold: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (longest runs of letters and digits) and the number of words of each text; fold as above."""
    codes, ends = folded(texts) if fold is None else fold
    kept = codes != 0
    starts = np.concatenate(([0], ends[:-1])) if len(texts) else ends
    first = kept.copy()
    if codes.size:
        first[1:] &= ~kept[:-1]
        own = starts[starts < codes.size]
        first[own] = kept[own]  # a text's first symbol begins a word whatever stands before it
    n_words = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    at = np.flatnonzero(kept)
    if not at.size:
        return np.zeros(0, U64), n_words
    begin = np.flatnonzero(first[at])
    lengths = np.diff(np.concatenate((begin, [at.size])))
    position = np.arange(at.size) - np.repeat(begin, lengths)
    weighted = _powers(0xD6E8FEB86659FD93 | 1, int(lengths.max()) + 1)[position]
    np.multiply(weighted, _mixed(codes[at], 0x632BE59BD9B4E019), out=weighted)
    return mix(np.add.reduceat(weighted, begin) + lengths.astype(U64)), n_words


def sequence_hash(word_hashes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words."""
    bounds = np.concatenate(([0], np.cumsum(n_words)))
    position = np.arange(word_hashes.size) - np.repeat(bounds[:-1], n_words)
    most = int(n_words.max()) if len(n_words) else 0
    weighted = word_hashes * _powers(0xA0761D6478BD642F | 1, most + 1)[position]
    return mix(_segment_sums(weighted, bounds[:-1], bounds[1:]) + n_words.astype(U64))


def shingles(word_hashes: np.ndarray, n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and how many each text has (with repetitions)."""
    counts = np.maximum(n_words - size + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(n_words)))
    total = int(counts.sum())
    offset = np.repeat(bounds[:-1], counts)
    inside = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    at = offset + inside
    out = np.zeros(total, U64)
    for k in range(size):
        out = mix(out + word_hashes[at + k] * U64(2 * k + 3)) if total else out
    return out, counts


def distinct_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each text, and how many each has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    values, at = values.copy(), 0
    for end in np.cumsum(counts).tolist():
        values[at:end].sort()
        at = end
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n min-hash values (uint32) of each text's shingles; texts without shingles give the largest value.

    Each value is the least product of the shingle's 32-bit hash with an odd random multiplier, after
    a xor with a random mask, modulo 2^32.
    """
    out = np.full((n, len(counts)), 0xFFFFFFFF, np.uint32)
    have = np.flatnonzero(counts > 0)
    if not have.size:
        return out.T
    base = (values >> U64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1][have]
    masks = np.random.default_rng(7).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    work = np.empty_like(base)
    for k, factor in enumerate(_multipliers(n)):
        np.bitwise_xor(base, masks[k], out=work)
        np.multiply(work, factor, out=work)
        out[k, have] = np.minimum.reduceat(work, starts)
    return out.T


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two arrays of distinct values."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, a.size + b.size - both


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


assert sys.byteorder == "little"
