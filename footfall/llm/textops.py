"""Vectorised text kernels over Arrow string arrays (numpy only, no Spark).

A chunk of texts is one byte buffer; words, lines and n-grams are found with array
operations over all of it, and every hash is a polynomial over the buffer read off
prefix sums, so that no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
#: White space between words: space and bytes 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(_MULT), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _MULT, np.uint64)]), dtype=np.uint64)
            _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)
    return _POW, _INV


class SpanHash:
    """64-bit hashes of arbitrary spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(values) + 1, np.uint64)
            np.multiply(values, power[: len(values)], out=self.sums[1:])
            np.cumsum(self.sums, out=self.sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def release() -> None:
    """Give back what a worker no longer needs; idle workers live on beside later stages."""
    global _POW, _INV
    if len(_POW) > 1 << 22:
        _POW = _INV = np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A batch function that releases memory when its partition ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def lean_group(f: Callable) -> Callable:
    """A group function that releases memory after a large group."""

    if f.__code__.co_argcount == 2:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(left, right)
            if left.nbytes + right.nbytes > 1 << 20:
                release()
            return out

        return both

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        if t.nbytes > 1 << 20:
            release()
        return out

    return one


class Memo:
    """What a worker has learnt about byte stretches: ids (and a number) by hash, in sorted arrays."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.size, self.worth = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def learn(self, keys: np.ndarray, ids: list, worth: np.ndarray | None = None) -> None:
        """Add unknown sorted keys with their id arrays."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        first = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        at = np.searchsorted(self.keys, keys)
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())) if ids and isinstance(ids[0], list) else np.concatenate(ids) if ids else self.flat[:0]
        self.flat = np.concatenate([self.flat, new])
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)
        self.worth = np.insert(self.worth, at, np.zeros(len(ids)) if worth is None else worth)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and offsets (one more than texts); null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a slice of texts."""

    data: np.ndarray  # the bytes, lower-cased where asked for
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray  # of the words in data
    end: np.ndarray
    doc: np.ndarray  # index of each word's text
    first: np.ndarray  # of each text's words; one more than texts
    hash: np.ndarray  # of each word


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Maximal runs of bytes other than space and 9 to 13; A-Z are lowered if asked for."""
    data, offsets = buffer_of(texts)
    if lower:
        data = _LOWER[data]
    n, docs = len(data), len(offsets) - 1
    solid = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    before[begins] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    last = offsets[1:][(offsets[1:] > 0)] - 1
    after[last] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(data, offsets, start, end, doc, first, SpanHash(_BYTE[data])(start, end) if n else np.zeros(0, np.uint64))


def joined_hash(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """Hash of tuples given as equally long columns of hashes; the order counts."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), np.uint64(0x2545F4914F6CDD1D + 2 * salt), np.uint64)
        for p in parts:
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
        return out


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every k-word shingle; a text of fewer words gives its whole sequence."""
    n = len(w.start)
    count = np.diff(w.first)
    full = np.flatnonzero(np.arange(n) + k <= np.repeat(w.first[1:], count)) if n else np.zeros(0, np.int64)
    doc, key = [w.doc[full]], [joined_hash([w.hash[full + j] for j in range(k)], k)] if len(full) else [np.zeros(0, np.uint64)]
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            at = w.first[few]
            doc.append(few)
            key.append(joined_hash([w.hash[at + j] for j in range(m)], m))
    return np.concatenate(doc), np.concatenate(key)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs values[start:start+length], one after the other."""
    total = int(length.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(length)
    return values[np.arange(total) + np.repeat(start - (ends - length), length)]


def ragged(starts: np.ndarray, values: pa.Array | np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list array from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))
