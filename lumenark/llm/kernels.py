"""Array kernels shared by the text operators.

Everything here works on one Arrow batch inside a task: Spark partitions and shuffles the rows, these helpers only
turn a run of UTF-8 bytes into words, word hashes and n-gram hashes without a Python loop over the characters. Batches
are cut into blocks of about ``BLOCK`` bytes so that the working set of a task stays small however long a batch is.

Hashes are 64-bit polynomial sums modulo 2**64 (an odd base has an inverse, so the hash of any slice is a difference of
prefix sums) passed through a bit mixer. They are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, at least ``n`` of each."""
    have = _CACHE.get(base)
    if have is None or len(have[0]) < n:
        made = _powers(base, max(n, BLOCK // 4))
        if len(made[0]) > 4 * BLOCK:  # a huge text: do not keep its tables
            return made
        _CACHE[base] = have = made
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


AS_IS, LOWER = np.arange(256, dtype=np.uint8), lowered()
#: Bytes of words that end at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits (of lower-cased text), and of anything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``limit`` bytes; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, and for each text of ``offsets`` the number of its first word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = AS_IS) -> np.ndarray:
    """A hash of each slice of ``buf``; ``table`` maps the bytes first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = powers(_BASE, len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((table[buf].astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts], 1)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words; across texts too, so the caller picks those that lie in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(_WORD_BASE, len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inv[:n], k)


def in_one_text(first: np.ndarray, k: int) -> np.ndarray:
    """For the first-word numbers of ``word_bounds``: which windows of ``k`` words lie in one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), dtype=bool)
    for end in first[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    return ok
