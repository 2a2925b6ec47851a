"""Words of whole Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes outside ``20 09-0D``. Those six bytes never occur inside a multi-byte UTF-8
sequence, so the bytes of a column can be cut at them without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Workers live on between tasks; the system's allocator gives large buffers back at once, Arrow's own pools keep them.
pa.set_memory_pool(pa.system_memory_pool())

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
#: Bytes of text that one step holds as arrays; a single longer text makes a step of its own.
STEP_BYTES = 3_000_000


@dataclass
class Words:
    data: np.ndarray  # all bytes of the column
    offsets: np.ndarray  # document boundaries in data, one more than documents
    starts: np.ndarray  # word boundaries in data
    ends: np.ndarray
    doc: np.ndarray  # document of each word

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Words of each document, or the sum of an integer weight over them."""
        if weights is None:
            return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        return np.bincount(self.doc, weights=weights, minlength=self.n_docs).astype(np.int64)

    def values(self) -> pa.Array:
        """The words themselves, as a binary Arrow array."""
        return spans(self.data, self.starts, self.ends)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document boundaries of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def marked(which: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``which[data]`` for a boolean of each byte value, several times as fast."""
    return np.frombuffer(data.tobytes().translate(which.tobytes()), bool)


def words_of(column: pa.Array, separator: np.ndarray = IS_SEPARATOR) -> Words:
    data, offsets = column_bytes(column)
    inside = ~marked(separator, data)
    begins = np.zeros(len(data) + 1, bool)  # a document's first byte begins a word even after a word
    begins[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, doc)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Disjoint ascending spans of ``data`` as a binary Arrow array."""
    n = len(starts)
    if not n:
        return pa.array([], pa.binary())
    bounds = np.empty(2 * n, np.int32)
    bounds[0::2], bounds[1::2] = starts, ends
    both = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, 2 * n - 1, 2, dtype=np.int32)))


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have at most ``most`` bytes together, or are one row."""
    data_bounds = column_bytes(column)[1]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(data_bounds, data_bounds[at] + most, side="right")) - 1
        to = max(to, at + 1)
        yield at, min(to, len(column))
        at = to


def text_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Number and rows of each block of a partition, whose number is the first column; text is the last. A block has at
    most ``most`` bytes of text, or is one row."""
    number = -1
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if number < 0 and batch.num_rows:
            number = batch.column(0)[0].as_py() << 24
        text = batch.column(batch.num_columns - 1)
        for at, to in steps(text, most):
            more = int(column_bytes(text.slice(at, to - at))[1][-1])
            if held and size + more > most:
                yield number, held
                held, size, number = [], 0, number + 1
            held.append(batch.slice(at, to - at))
            size += more
    if held:
        yield number, held


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


# --- hashes of words -------------------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15

#: Steps of what hashes words: the tables of powers are as long as a step.
HASH_STEP_BYTES = 1_000_000

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, kept by each worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, HASH_STEP_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums: the cost follows the bytes, not the longest word."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed_bits((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
