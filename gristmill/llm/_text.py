"""Vectorised text kernels shared by the corpus operators.

A Spark Arrow batch of texts is cut into slabs of a bounded number of bytes;
inside a slab every word is located and hashed with a handful of NumPy passes
over the UTF-8 bytes, so no Python object is made per word.  A word is a maximal
run of bytes other than ASCII white space (0x20, 0x09-0x0D).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20
#: Bytes hashed at once: small, so that what is made of them stays in the processor's cache.
_CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators where a word is a run of ASCII letters and of bytes of other characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def _weight(lower: bool, sep: np.ndarray) -> np.ndarray:
    """What each byte adds to a word's key; separators add nothing."""
    value = _LOWER if lower else np.arange(256, dtype=np.uint8)
    return (value.astype(np.uint64) + np.uint64(1)) * (~sep).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(256)


def _pow_table(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(1 << int(n - 1).bit_length())
    return _POW


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 rows, bytes) of a string array; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, start = len(column), column.offset
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1 + start)[start:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def slabs(column: pa.Array, most: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer text is a slab of its own."""
    offsets, _ = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a slab of texts.

    raw, doc_off: bytes and the offsets of the texts; start, end: byte ranges of
    the words; doc: text of each word; ptr: first word of each text (n + 1);
    key: 64-bit hash of each word, of its A-Z lower-cased form if `lower`.
    """

    def __init__(self, column: pa.Array, lower: bool = True, sep: np.ndarray = _SEP):
        self.doc_off, self.raw = string_buffers(column)
        self.n = len(self.doc_off) - 1
        size = len(self.raw)
        word = ~sep[self.raw]
        edge = np.zeros(size + 1, bool)
        edge[self.doc_off] = True
        first = word.copy()
        last = word.copy()
        if size:
            first[1:] &= ~word[:-1] | edge[1:size]
            last[:-1] &= ~word[1:] | edge[1:size]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.doc_off).astype(np.int64)
        self.counts = np.diff(self.ptr)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int64), self.counts)
        self.weight = _weight(lower, sep)
        self.key = self._keys(self.weight)

    def _keys(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + _CHUNK)))
            a, b = self.start[lo], self.end[hi - 1]
            begin = self.start[lo:hi] - a
            place = np.arange(b - a, dtype=np.int64)
            place -= np.repeat(begin, np.diff(np.append(begin, b - a)))
            # only white space lies beyond the longest word, and it weighs nothing
            np.minimum(place, int((self.end[lo:hi] - self.start[lo:hi]).max()), out=place)
            table = _pow_table(int(place.max()) + 1)
            out[lo:hi] = np.add.reduceat(weight[self.raw[a:b]] * table[place], begin)
            lo = hi
        return mix(out)

    def prefix_keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, key of its first `size` bytes) of the words that are longer than that."""
        at = np.flatnonzero(self.end - self.start > size)
        table = _pow_table(size + 2)
        value = np.full(len(at), table[size + 1], np.uint64)
        for k in range(size):
            value += self.weight[self.raw[self.start[at] + k]] * table[k + 1]
        return at, mix(value)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, 64-bit key) of every run of n words inside a text."""
        total = len(self.key)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(total - n + 1, np.uint64)
        factor = _powers(n + 1)
        for k in range(n):
            value += self.key[k : total - n + 1 + k] * factor[k + 1]
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return at, mix(value[at])

    def per_doc(self, values: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Sum of values by text."""
        return np.bincount(self.doc if doc is None else doc, weights=values, minlength=self.n).astype(np.int64)

    def bytes_sum(self, flags: np.ndarray) -> np.ndarray:
        """Sum by text of a flag of each byte."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.doc_off[1:]] - total[self.doc_off[:-1]]

    def text(self, i: int) -> bytes:
        return self.raw[self.doc_off[i] : self.doc_off[i + 1]].tobytes()

    def word_bytes(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def repeated_in_doc(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether another item of the same text has the same key."""
    both = mix(key ^ (doc.astype(np.uint64) * _MULT))
    order = np.argsort(both)
    ranked = both[order]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


def distinct_in_doc(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) without repeats, by text and then ascending key."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return d[keep], k[keep]


def covered(total: int, first: np.ndarray, width: int) -> np.ndarray:
    """Whether each of `total` places lies in a window of `width` places from one of `first`."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + width, total), -1)
    return np.cumsum(step[:-1]) > 0


def signed(key: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return key.view(np.int64)


def arrow_type(spark_type):
    """The Arrow type in which Spark passes a column of this type."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)
