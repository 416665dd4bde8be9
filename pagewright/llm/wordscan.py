"""Vectorised work on words, lines and their hashes in Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A span's hash is a polynomial over its bytes, taken from
running sums, then mixed; sequences of words hash the same way over their words' hashes. Such hashes only say where
to look: equality is settled by ``span_ids`` and ``gram_ids``, which number spans by their bytes. Everything works on
slices of a few megabytes, so memory stays flat however long a batch is; a single longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xD1342543DE82EF95 | 1
STEP = 1 << 17
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


POW, POW_INV = powers(BASE, STEP + 1), powers(BASE_INV, STEP + 1)


class Texts:
    """Bytes of consecutive rows; ``edges`` has the rows' byte offsets."""

    def __init__(self, arr: pa.Array):
        if arr.null_count:
            arr = arr.fill_null("")
        kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
        edges = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
        data = arr.buffers()[2] if len(arr) else None
        self.bytes = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
        self.edges = edges - edges[0]
        self.n = len(arr)

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        """Offsets into sorted ``positions`` where each row's begin; n + 1 values."""
        return np.searchsorted(positions, self.edges)

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of all words, and where each row's words begin. ``inside``: by byte, whether it belongs
        to a word; without it, all but blanks do."""
        solid = ~SPACE[self.bytes] if inside is None else inside[self.bytes]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = self.edges[(self.edges > 0) & (self.edges < len(self.bytes))]
        starts[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, self.rows_of(s)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start and end bytes of all lines (split at \n), and where each row's lines begin."""
        breaks = np.flatnonzero(self.bytes == 10)
        row_of_break = np.searchsorted(self.edges, breaks, "right") - 1
        starts = np.concatenate([self.edges[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.edges[1:]])
        s_row = np.concatenate([np.arange(self.n), row_of_break])
        e_row = np.concatenate([row_of_break, np.arange(self.n)])
        so, eo = np.lexsort((starts, s_row)), np.lexsort((ends, e_row))
        return starts[so], ends[eo], np.searchsorted(s_row[so], np.arange(self.n + 1))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span; starts and ends ascend."""
        at_start, at_end = np.zeros(len(starts), U), np.zeros(len(ends), U)
        back = np.ones(len(starts), U)
        carry, scale, scale_inv = 0, 1, 1
        total = len(self.bytes)
        for o in range(0, max(total, 1), STEP):
            k = min(STEP, total - o)
            sums = np.zeros(k + 1, U)
            np.cumsum(BYTE_CODE[self.bytes[o : o + k]] * POW[:k], out=sums[1:])
            sums = sums * U(scale) + U(carry)
            i, j = np.searchsorted(starts, [o, o + STEP])
            at_start[i:j] = sums[starts[i:j] - o]
            back[i:j] = POW_INV[starts[i:j] - o] * U(scale_inv)
            i, j = np.searchsorted(ends, [o + (o > 0), o + STEP + 1])
            at_end[i:j] = sums[ends[i:j] - o]
            carry = int(sums[-1])
            scale, scale_inv = scale * int(POW[STEP]) & MASK, scale_inv * int(POW_INV[STEP]) & MASK
        return mix((at_end - at_start) * back + (ends - starts).astype(U))


def span_ids(t: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span (ascending, not overlapping): equal if and only if all bytes are."""
    mark = np.zeros(len(t.bytes) + 1, np.int8)
    full = ends > starts
    mark[starts[full]] += 1
    mark[ends[full]] -= 1  # where a span begins as another ends, the bytes of both are inside
    data = t.bytes[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of values, equal if and only if both are; values are at least 0 and below 2**31."""
    if not len(a):
        return np.zeros(0, np.int64)
    return pa.array(a * (int(b.max()) + 1) + b).dictionary_encode().indices.to_numpy().astype(np.int64)


def gram_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for every ``k`` consecutive values of ``ids``, equal if and only if all values are."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, done, part, size = None, 0, ids, 1
    while True:  # binary parts of k: part numbers runs of ``size``
        if k & size:
            piece = part[done : done + n]
            out = piece if out is None else paired(out, piece)
            done += size
        if size * 2 > k:
            return out
        part = paired(part[:-size], part[size:])
        size *= 2


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values of ``h``; rows are not looked at. Length len(h) - k + 1 or 0."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    done, out = 0, np.zeros(n, U)
    part, size = h, 1
    while True:  # binary parts of k: part holds windows of ``size``
        if k & size:
            out = out * U(pow(WORD_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if size * 2 > k:
            break
        part = part[:-size] * U(pow(WORD_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mix(out + U(k))


def row_index(offsets: np.ndarray) -> np.ndarray:
    """For offsets of n rows, the row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of ``k`` items, by first item, lie in one row."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, bool)
    last = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n - k + 1) + k <= last[: n - k + 1]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``most`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(Texts(batch.column(column)).edges)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
