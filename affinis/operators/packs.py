"""Rows packed by the group that they go to, so that few large rows are moved instead of many small ones.

A row on its way through Spark, a shuffle and Arrow costs far more than its
numbers. Each task takes its rows some megabytes at a time, repeats a row for
each of its groups, and writes the rows of one group end to end, one binary per
column. A pack holds at most ``PACK_BYTES``, or the copies of a single row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from affinis.functions.arrow import matrix, one_array, ragged

# Copies of rows that a task packs at a time.
PACK_BYTES = 8 * 1024 * 1024


def _groups(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, groups): the groups of row r are groups[offsets[r]:offsets[r + 1]]."""
    if pa.types.is_list(column.type):
        offsets, groups = ragged(column)
        return offsets.astype(np.int64), groups
    groups = one_array(column).to_numpy()
    return np.arange(len(groups) + 1), groups


def _binaries(rows: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The rows from each edge to the next as one binary."""
    data = np.ascontiguousarray(rows)
    offsets = (edges * (data.itemsize * data.shape[1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _pack(table: pa.Table, widths: dict[str, int], most: int) -> Iterator[pa.RecordBatch]:
    group, *names = table.column_names
    offsets, groups = _groups(table[group])
    values = [matrix(table[name], widths[name]) if name in widths else one_array(table[name]).to_numpy()[:, None] for name in names]
    first = 0
    while first < len(table):
        last = min(len(table), max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1))
        own = groups[offsets[first] : offsets[last]]
        order = np.argsort(own, kind="stable")
        row = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))[order]
        own = own[order]
        if len(own):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            edges = np.append(starts, len(own))
            columns = [pa.array(own[starts], pa.int32()), *(_binaries(column[row], edges) for column in values)]
            yield pa.RecordBatch.from_arrays(columns, names=[group, *names])
        first = last


def packed(rows: DataFrame, widths: dict[str, int], pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The columns of ``rows`` as binaries, by the first one.

    The first column is the group of a row, an int, or a list of the groups to
    which it goes. The others are numbers of 64 bits or, named in ``widths``,
    lists of so many of them. Nothing is null.
    """
    group, *names = rows.columns
    most = max(1, pack_bytes // (8 * (1 + sum(widths.get(name, 1) for name in names))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, copies = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            copies += int(_groups(pa.chunked_array([batch.column(0)]))[0][-1])
            if copies >= most or sum(len(one) for one in held) >= most:
                yield from _pack(pa.Table.from_batches(held), widths, most)
                held, copies = [], 0
        if held:
            yield from _pack(pa.Table.from_batches(held), widths, most)

    schema = T.StructType([T.StructField(group, T.IntegerType()), *(T.StructField(name, T.BinaryType()) for name in names)])
    return rows.mapInArrow(pack, schema)


def unpacked(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    """The numbers of all packs of a column, in their order."""
    parts = [np.zeros(0, dtype=np.uint8)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if data is not None:
            parts.append(np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]])
    return np.concatenate(parts).view(kind)
