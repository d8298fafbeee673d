"""Array kernels over the UTF-8 bytes of an Arrow text column.

A chunk is a run of whole documents laid end to end in one byte array, with
the documents' offsets. Words and their polynomial (Rabin-Karp) hashes are
found for all documents of a chunk at once.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
U = np.uint64


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of at most `limit` bytes of text; a longer text stands alone. At the end the worker gives back what it has freed."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns what a task has freed to the machine, for a worker lives on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def to_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary column from bytes and offsets."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: The Mersenne prime of all hashes: sums and products stay exact in 64-bit numbers.
PRIME = (1 << 61) - 1
_M = U(PRIME)
#: A word of up to SHORT bytes is its own value; one of more than LONG bytes is hashed by keyed BLAKE2b.
SHORT, LONG = 7, 112


def fresh_key() -> int:
    """A random base. The driver draws it for what tasks must agree on, a worker for what it keeps to itself:
    as nobody knows it when texts are written, two different words of n bytes have one hash with a
    probability of at most n / 7 in 2^61, whatever the words are."""
    return secrets.randbelow(PRIME - (1 << 32)) + (1 << 31)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> U(61))
    return np.where(x >= _M, x - _M, x)


def mulmod(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of values below it."""
    low, half = U(0xFFFFFFFF), U(32)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    x = a0 * b0
    out = ((a1 * b1) << U(3)) + (mid >> U(29)) + ((mid & U((1 << 29) - 1)) << half) + (x & _M) + (x >> U(61))
    return _reduce(out)


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums modulo PRIME of the values before each place."""
    out = np.zeros(len(x) + 1, U)
    low, high = np.cumsum(x & U(0xFFFFFFFF)), np.cumsum(x >> U(32))
    out[1:] = _reduce((low & _M) + (low >> U(61)) + (high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32)))
    return out


class Hash:
    """Polynomial (Rabin-Karp) hashes modulo PRIME of words and of windows of words, by a secret base."""

    def __init__(self, key: int):
        self.key, self.base = key, U(key)
        self.inverse = pow(key, -1, PRIME)
        self.up = self.down = np.ones(1, U)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Values of the words data[start:end]: of words of up to SHORT bytes different for different words."""
        size = ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

        def block(at: np.ndarray, n: np.ndarray) -> np.ndarray:
            return eight[at] & ((U(1) << (n.astype(U) << U(3))) - U(1))

        out = block(starts, np.minimum(size, SHORT)) | (np.minimum(size, SHORT).astype(U) << U(56))
        on = np.flatnonzero((size > SHORT) & (size <= LONG))
        if len(on):
            acc, at, left = out[on] ^ U(1 << 60), starts[on] + SHORT, size[on] - SHORT
            while len(on):
                n = np.minimum(left, SHORT)
                acc = _reduce(mulmod(acc, self.base) + block(at, n) + (n.astype(U) << U(56)))
                left, at = left - n, at + n
                out[on] = acc
                more = left > 0
                on, acc, at, left = on[more], acc[more], at[more], left[more]
        for i in np.flatnonzero(size > LONG).tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=self.key.to_bytes(8, "little")).digest(), "little") % PRIME
        return out

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, mulmod(self.up, U(pow(self.key, k, PRIME)))])
            self.down = np.concatenate([self.down, mulmod(self.down, U(pow(self.inverse, k, PRIME)))])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        return prefix_sums(mulmod(values, self.up[: len(values)]))

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the values from start to end, wherever they stand."""
        difference = prefix[ends] + (_M - prefix[starts])
        return mulmod(np.where(difference >= _M, difference - _M, difference), self.down[starts])


def in_class(data: np.ndarray, *spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return in_class(data, (9, 13), (32, 32))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none across two documents, and each document's first run."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """The words where the windows of k words of one document start."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def windows(h: Hash, values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows of k words of one document, and the words where they start."""
    at = window_starts(first, k)
    return h.spans(h.prefix(values), at, at + k), at


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words stand in a window of k words starting at any of `at`."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1) if len(at) < 64 else d.__iadd__(np.bincount(at, minlength=n + 1)[: n + 1])
    d2 = np.bincount(np.minimum(at + k, n), minlength=n + 1)[: n + 1] if len(at) else 0
    return np.cumsum(d - d2)[:n] > 0


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per-position values over each document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], end to end."""
    to = np.cumsum(lengths)
    n = int(to[-1]) if len(to) else 0
    return flat[np.repeat(starts - (to - lengths), lengths) + np.arange(n)]
