"""Arrow text columns as flat byte arrays, and vectorised hashing of their words.

A block is a run of rows: `data` holds their UTF-8 bytes end to end (uint8) and
`offs` the n + 1 row borders. Null text is empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 65536), base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def text_array(column) -> pa.Array:
    """A text column without nulls, as large_binary."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string()).cast(pa.large_binary())


def blocks(array: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) for runs of rows of about `size` bytes; a longer text is a run of its own."""
    n = len(array)
    if not n:
        return
    _, obuf, dbuf = array.buffers()
    offs = np.frombuffer(obuf, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(dbuf, np.uint8) if dbuf is not None and dbuf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 65536)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, starts before each row border) of the runs of true bytes; no run crosses a row border."""
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    if len(mask):
        before[1:] = mask[:-1]
        before[offs[:-1][offs[:-1] < len(mask)]] = False
        after[:-1] = mask[1:]
        last = offs[1:] - 1
        after[last[last >= 0]] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offs)


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs() of the words: bytes other than 0x20 and 0x09-0x0D."""
    return runs(~_WS[data], offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * powers(_MULT, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_MULT_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words before each row border)."""
    if lower:
        data = _LOWER[data]
    starts, ends, before = word_bounds(data, offs)
    return span_hashes(data, starts, ends), before


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's set of distinct k-word shingles as a sorted array of 64-bit hashes; fewer words make one shingle."""
    words, before = word_hashes(data, offs)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, U64)
        for j in range(k):
            rolled = mix(rolled * U64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
    sets = []
    for i in range(len(offs) - 1):
        a, b = int(before[i]), int(before[i + 1])
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.full(1, b - a, U64)
            for j in range(a, b):
                one = mix(one * U64(0xD6E8FEB86659FD93) + words[j : j + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, U64))
    return sets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of every run, end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    step[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
