"""Bytes, words and 64-bit hashes of Arrow text columns, used inside tasks.

A word is a maximal run of ASCII letters (case-folded), ASCII digits and
characters outside ASCII. In UTF-8 the latter are exactly the bytes from 0x80,
so words can be found byte by byte. Null is the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed at once; bounds the memory of one step whatever the batch or text.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


FOLD, IN_WORD = _fold_table(), _word_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the finaliser of SplitMix64)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def powers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value per byte, ascending powers, descending powers) of the polynomial hash."""
    value = mix(np.arange(1, 257, dtype=_U64)) | _U64(1)
    steps = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(length + 1, base, dtype=_U64)
        step[0] = 1
        steps.append(np.cumprod(step, dtype=_U64))
    return value, *steps


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row r is bytes[offsets[r]:offsets[r + 1]]."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded(batches, at: int, most: int = 8 << 20):
    """The batches in slices of at most ``most`` bytes of column ``at``; a longer text comes alone."""
    for batch in batches:
        _, offsets = utf8(batch.column(at))
        row = 0
        while row < len(batch):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that stay inside a row."""
    if not len(member):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.empty(len(member), dtype=bool)
    first[0] = True
    np.logical_not(member[:-1], out=first[1:])
    edges = offsets[(offsets > 0) & (offsets < len(member))]
    first[edges] = True
    last = np.empty(len(member), dtype=bool)
    last[-1] = True
    np.logical_not(member[1:], out=last[:-1])
    last[edges - 1] = True
    return np.flatnonzero(first & member), np.flatnonzero(last & member) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLD) -> np.ndarray:
    """64-bit hashes of the given ascending, disjoint byte spans; ``table`` maps bytes, by default to lower case."""
    value, up, down = powers(min(BLOCK_BYTES, len(raw)))
    out = np.empty(len(starts), dtype=_U64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        stop = int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right"))
        if stop <= at:  # one span longer than a block
            text = table[raw[begin : ends[at]]].tobytes()
            out[at] = xxhash.xxh64_intdigest(text)
            at += 1
            continue
        block = value[table[raw[begin : ends[stop - 1]]]]
        block *= up[: len(block)]
        total = np.zeros(len(block) + 1, dtype=_U64)
        np.cumsum(block, out=total[1:])
        s, e = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U64))
        at = stop
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row boundaries): the words of row r are hashes[bounds[r]:bounds[r + 1]]."""
    raw, offsets = utf8(column)
    starts, ends = spans(IN_WORD[raw], offsets)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, offsets)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U64(_BASE) + (right ^ _U64(0xD6E8FEB86659FD93)))


def distinct(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ascending positions of the first of equal (row, key) pairs; rows ascend."""
    if not len(row):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((key, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    return np.sort(order[new])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


class Lookup:
    """Values by 64-bit key; unknown keys give zero."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self._seen = np.zeros(1 << 22, dtype=bool)
        self._seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> _U64(42)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, known) per key."""
        value = np.zeros((len(keys), *self.values.shape[1:]), dtype=self.values.dtype)
        known = np.zeros(len(keys), dtype=bool)
        maybe = np.flatnonzero(self._seen[self._slot(keys)])
        if len(maybe):
            asked = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            same = self.keys[at] == asked
            known[maybe[same]] = True
            value[maybe[same]] = self.values[at[same]]
        return value, known
