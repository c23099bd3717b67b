"""Packing texts into sequences of several permitted lengths.

Texts longer than the largest capacity are cut into pieces of it; nothing else
is cut. Pieces are dealt by hash to blocks of bounded size, and each block is
packed by itself: longest piece first, into the open bin it leaves the least
room in. When no open bin has room, the capacity to open is the one with the
least expected cost per token: its cost over the piece and the part of the
remaining room that shorter pieces can still fill, beyond the room already
open. At the end each bin shrinks to the smallest capacity that holds its
contents.

Blocks hold thousands of pieces, so what splitting costs is at most a few
half-filled bins in each.

Defined cases: null and texts without tokens need no room and get no bin (null);
repeated rows are packed each; an empty table gives no rows; an input column
named like an output column is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from affinis.llm.frames import pick
from affinis.llm.text import IN_WORD, bounded, spans, utf8
from affinis.runtime import GenerationStore

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: its positions, weighted for attention over them, and a fixed part.
ATTENTION_LENGTH, FIXED_COST = 32_768, 16
#: Tokens and pieces of one block, on average.
BLOCK_TOKENS, BLOCK_PIECES = 1 << 22, 1 << 17


def bin_cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION_LENGTH) + FIXED_COST


def count_tokens(column: pa.Array) -> np.ndarray:
    """Words, and other visible ASCII characters, of each text."""
    raw, offsets = utf8(column)
    single = (raw > 32) & (raw < 127) & ~IN_WORD[raw]
    begins = single.astype(np.int64)
    begins[spans(IN_WORD[raw], offsets)[0]] += 1
    return np.diff(np.append(0, np.cumsum(begins))[offsets])


def pack_block(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of its bin) of each piece; ``lengths`` descend and fit the largest capacity."""
    sizes = sorted(capacities)
    costs = [bin_cost(size) for size in sizes]
    ascending = lengths[::-1]
    below = np.append(0, np.cumsum(ascending))
    count = len(lengths)
    rooms: list[int] = []
    bins_by_room: dict[int, list[int]] = {}
    used: list[int] = []
    open_room = 0
    which, offset = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    for at, length in enumerate(lengths.tolist()):
        fit = bisect_left(rooms, length)
        if fit < len(rooms):
            room = rooms[fit]
            number = bins_by_room[room].pop()
            if not bins_by_room[room]:
                del bins_by_room[room]
                rooms.pop(fit)
            open_room -= room
        else:
            best = None
            for size, cost in zip(sizes, costs, strict=True):
                if size >= length:
                    room = size - length
                    shorter = min(int(np.searchsorted(ascending, room, side="right")), count - at - 1)
                    filled = min(room, max(0, int(below[shorter]) - open_room))
                    if best is None or cost / (length + filled) < best[0]:
                        best = (cost / (length + filled), size)
            room, number = best[1], len(used)
            used.append(0)
        which[at], offset[at] = number, used[number]
        used[number] += length
        room -= length
        if room:
            if room not in bins_by_room:
                insort(rooms, room)
            bins_by_room.setdefault(room, []).append(number)
            open_room += room
    smallest = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, dtype=np.int64)
    return which, offset, smallest[which] if count else which


def pack(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, block_tokens: int = BLOCK_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece of ``documents`` (doc_id, text).

    Columns: doc_id, piece (from 0), piece_start and piece_tokens, bin,
    bin_capacity, and bin_offset (tokens before the piece in its bin).
    """
    rows = pick(documents, "doc_id", "text")
    id_field = rows.schema["doc_id"]
    largest = max(capacities)

    def cut(batches):
        for batch in bounded(batches, 1):
            tokens = count_tokens(batch.column(1))
            parts = np.maximum(1, -(-tokens // largest))
            row = np.repeat(np.arange(len(tokens)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * largest
            size = np.minimum(tokens[row] - start, largest)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "piece_start", "piece_tokens"])

    fields = [
        id_field,
        StructField("piece", IntegerType()),
        StructField("piece_start", LongType()),
        StructField("piece_tokens", IntegerType()),
    ]
    pieces = GenerationStore(rows.sparkSession).write(
        "pieces", rows.mapInArrow(cut, StructType(fields)).withColumn("piece_no", F.monotonically_increasing_id())
    )
    tokens, count = pieces.agg(F.coalesce(F.sum("piece_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-tokens // block_tokens), -(-count // block_pieces))
    placed = [*fields, StructField("bin", LongType()), StructField("bin_capacity", IntegerType()), StructField("bin_offset", IntegerType())]

    def place(key, table):
        size = table.column("piece_tokens").to_numpy().astype(np.int64)
        order = np.lexsort((table.column("piece_no").to_numpy(), -size))
        which, offset, capacity = pack_block(size[order], capacities)
        out = table.take(pa.array(order)).drop_columns(["block", "piece_no"])
        first = key[0].as_py() << 32
        return (
            out.append_column("bin", pa.array(which + first))
            .append_column("bin_capacity", pa.array(capacity.astype(np.int32)))
            .append_column("bin_offset", pa.array(offset.astype(np.int32)))
        )

    block = F.pmod(F.xxhash64("piece_no"), F.lit(blocks))
    packed = pieces.filter("piece_tokens > 0").withColumn("block", block).groupBy("block").applyInArrow(place, StructType(placed))
    roomless = pieces.filter("piece_tokens = 0").select(
        *(field.name for field in fields), *(F.lit(None).cast(field.dataType).alias(field.name) for field in placed[len(fields) :])
    )
    return packed.unionByName(roomless)
