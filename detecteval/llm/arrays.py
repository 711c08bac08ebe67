"""Text batches as flat numpy arrays, shared by the operators that leave the JVM.

Spark hands over Arrow batches; a batch is cut into pieces of whole texts of
about ``max_bytes`` bytes, so the arrays stay small whatever the batch holds
(one text longer than that is a piece of its own: memory is bound by the
longest text, never by the number of rows). A null text counts as empty.
"""
from __future__ import annotations

import ctypes
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

U64 = np.uint64


class Piece(NamedTuple):
    """Rows ``lo:hi`` of the batch: their bytes and the byte offset of each text."""
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text_bytes(self, i: int) -> memoryview:
        return memoryview(self.data)[self.offsets[i]:self.offsets[i + 1]]


def text_pieces(column: pa.Array, max_bytes: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Piece(lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def give_back_memory() -> None:
    """Hand what the allocators keep of freed memory back to the system, for processes
    that live on beside a JVM: the driver after a fit, workers after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run):
    """``run`` for ``mapInArrow``, giving the worker's freed memory back at the task's end."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back_memory()
    return whole


def map_batches(df, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, release: bool = False):
    """``mapInArrow`` with one function per batch (a batch may give several)."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(released(run) if release else run, schema)


def sum_cells(parts):
    """Sums of the arrays (binary of doubles, one length for each cell) of (cell long, data binary)."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data)
                total[cell] = total[cell] + part if cell in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()),
                                          pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["cell", "data"])
    return parts.repartition("cell").mapInArrow(released(run), "cell long, data binary")


def char_counts(p: Piece) -> np.ndarray:
    """Code points of each text."""
    lead = np.concatenate(([0], np.cumsum((p.data & 0xC0) != 0x80, dtype=np.int64)))
    return lead[p.offsets[1:]] - lead[p.offsets[:-1]]


def codepoints(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the piece and the offset of each text in them."""
    cps = np.frombuffer(p.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"),
                        dtype=np.uint32)
    return cps, np.concatenate(([0], np.cumsum(char_counts(p))))


# -- hashing -----------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64((seed * 2 + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)))


_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = stream(11, 256)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, kept and grown by need."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 2 * PIECE_BYTES)
        got = np.empty(size, U64)
        got[0] = 1
        got[1:] = U64(base)
        got = np.multiply.accumulate(got)
        _powers[base] = got
    return got[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power(_BASE_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U64))


# -- words -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words(NamedTuple):
    """Word spans of a piece; ``offsets[i]:offsets[i+1]`` are the words of text i."""
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes other than ASCII white space, never across texts.

    ``space`` overrides the per-byte separator mask."""
    n = len(data)
    space = _SPACE[data] if space is None else space
    word = ~space
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:n] if n else word
    after = np.concatenate((word[1:], [False])) & ~edge[1:] if n else word
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), span_hashes(data, starts, ends))


_ORDER = stream(23, 64) | U64(1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, repeats included, and
    their offsets. A text with fewer words, but at least one, has its whole
    word sequence as its only shingle."""
    h, offs = words.hashes, words.offsets
    count = np.diff(offs)
    n_sh = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    out_offs = np.concatenate(([0], np.cumsum(n_sh)))
    total = int(out_offs[-1])
    if total == 0:
        return np.zeros(0, U64), out_offs
    doc = np.repeat(np.arange(len(count)), n_sh)
    at = np.arange(total) - out_offs[doc] + offs[doc]
    acc = np.zeros(total, U64)
    last = len(h) - 1
    long = count[doc] >= size
    for j in range(size):
        inside = long | (j < count[doc])
        acc += np.where(inside, h[np.minimum(at + j, last)] * _ORDER[j], U64(0))
    acc += np.where(long, U64(size), count[doc].astype(U64))
    return mix(acc), out_offs


def distinct_per_text(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each text."""
    return [np.unique(values[offsets[i]:offsets[i + 1]]) for i in range(len(offsets) - 1)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
