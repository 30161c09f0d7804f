"""Texts of an Arrow batch as flat byte arrays: words, hashes and windows without
a Python object per word. Works inside tasks on slices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
MIX = np.uint64(0xBF58476D1CE4E5B9)
U0, U1, U29, U32 = np.uint64(0), np.uint64(1), np.uint64(29), np.uint64(32)


def slices(column, max_bytes: int = SLICE_BYTES):
    """Yield ``(first_row, end_row, data, offsets)`` over a string column.

    ``data`` is the uint8 array of the rows' UTF-8 bytes and ``offsets`` (int64,
    from 0) their bounds. A slice has at least one row and, but for one longer
    text alone, at most ``max_bytes`` bytes. Nulls are empty.
    """
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, buf = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def text_slices(column, max_bytes: int):
    """Yield the texts of a string column as lists of bounded size (null stays None)."""
    for lo, hi, _, _ in slices(column, max_bytes):
        yield column.slice(lo, hi - lo).to_pylist()


class Powers:
    """Powers of ODD and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.base = self.inverse = np.empty(0, np.uint64)

    def upto(self, n: int):
        if len(self.base) < n:
            size = max(n, SLICE_BYTES + 1)
            inv = np.uint64(pow(int(ODD), -1, 1 << 64))
            self.base = np.cumprod(np.concatenate([[U1], np.full(size - 1, ODD)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[U1], np.full(size - 1, inv)]), dtype=np.uint64)
        return self.base[:n], self.inverse[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads the bits (works on a copy)."""
    h = h ^ (h >> U32)
    h *= MIX
    h ^= h >> U29
    h *= ODD
    h ^= h >> U32
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers,
                 sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` by one prefix sum; equal content and length
    give equal hashes wherever it stands."""
    if sums is None:
        sums = prefix_sums(values, powers)
    _, inv = powers.upto(len(sums))
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * MIX)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    base, _ = powers.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + U1) * base[:len(values)], out=sums[1:])
    return sums


def equal_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ``values[a:a + n]`` equals ``values[b:b + n]``, for each of the lengths."""
    before = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    unlike = values[np.repeat(a, lengths) + at] != values[np.repeat(b, lengths) + at]
    if not unlike.any():
        return np.ones(len(lengths), bool)
    sums = np.concatenate([[0], np.cumsum(unlike)])
    return sums[before + lengths] == sums[before]


def exact_labels(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers that are equal where ``values[s:e]`` are: grouped by their hashes, and
    compared with the first of the group. Where different ones share a hash they are
    numbered by themselves."""
    _, first, label = np.unique(hashes, return_index=True, return_inverse=True)
    copies = np.flatnonzero(first[label] != np.arange(len(label)))
    head = first[label[copies]]
    lengths = ends - starts
    same = lengths[copies] == lengths[head]
    if same.all() and equal_ranges(values, starts[copies], starts[head], lengths[copies]).all():
        return label
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(values[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends)], np.int64)


def word_bounds(is_word: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of the maximal runs of word bytes; no run crosses a row."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def table(test) -> np.ndarray:
    """A 256-entry lookup table of a predicate over byte values."""
    return np.array([bool(test(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLANK = table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
CONTINUATION = table(lambda b: 0x80 <= b <= 0xBF)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]
