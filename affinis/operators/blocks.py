"""Block layout of the train matrix for the half-steps.

Rows of the matrix (users in one layout, items in the other) are hashed into
blocks. A block keeps, per row, the sorted numbers of its neighbours, and each
factor row of the other side is mailed once to every block that needs it, not
once per interaction. Rows with very many neighbours are cut into slices that
live in different blocks. Blocks that the hash made larger than their bound are
cut at values of a second hash, so that the bound holds for every block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.expressions import bucket
from affinis.operators.skew import ROWS_PER_SLICE, heavy_keys, with_slice
from affinis.runtime import cut_lineage

# Memory of one block: its pairs, and in the worst case one factor row per pair.
BLOCK_BYTES = 256 * 1024 * 1024
# Of a pair besides numbers of a factor row: what its own and the mailed row's other columns take in a task.
_PAIR_BYTES = 64
# Share of a block that is filled on average, so that hashing seldom overfills one and cuts are the exception.
_FILLED = 0.9
# Shuffle partitions stay below this; further blocks share partitions.
MAX_PARTITIONS = 20_000


@dataclass(frozen=True)
class Layout:
    """``lists``: (block, id, heavy, neighbours); ``heavy``: (id, slices) or None.

    ``cuts``: (hashed, first, edges) of the blocks that were cut, or None.
    """

    lists: DataFrame
    heavy: DataFrame | None
    blocks: int
    partitions: int
    hashed_blocks: int
    cuts: DataFrame | None = None

    def placed(self, rows: DataFrame, slice_: Column) -> DataFrame:
        """``rows`` with the ``block`` that holds the list of their id and slice."""
        return _placed(rows, slice_, self.hashed_blocks, self.cuts)

    @cached_property
    def kept_routes(self) -> DataFrame:
        """``routes`` written once, for layouts that serve several runs."""
        return cut_lineage(routes(self))

    def unpersist(self) -> None:
        self.lists.unpersist()


def pairs_per_block(rank: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Pairs that fit in a block when each needs a factor row of its own."""
    return max(1, block_bytes // (8 * (rank + 1) + _PAIR_BYTES))


def block_count(pairs: int, rank: int, parallelism: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Enough blocks for the memory bound and for every core."""
    return max(1, parallelism, math.ceil(pairs / (_FILLED * pairs_per_block(rank, block_bytes))))


def _order(slice_: Column) -> Column:
    """Place of a list inside its hashed block."""
    return F.xxhash64("id", slice_, F.lit(1))


def _placed(rows: DataFrame, slice_: Column, blocks: int, cuts: DataFrame | None) -> DataFrame:
    hashed = bucket(blocks, F.col("id"), slice_)
    if cuts is None:
        return rows.withColumn("block", hashed)
    before = F.coalesce(F.size(F.filter("edges", lambda edge: edge <= F.col("_order"))), F.lit(0))
    marked = rows.withColumn("_hashed", hashed).withColumn("_order", _order(slice_))
    met = marked.join(cuts, marked["_hashed"] == cuts["hashed"], "left")
    block = F.when(F.col("hashed").isNull() | (before == 0), F.col("_hashed")).otherwise(F.col("first") + before - 1)
    return met.select(*rows.columns, block.cast("int").alias("block"))


def _largest_block(sliced: DataFrame, blocks: int, table_rows: int | None, block_pairs: int) -> int:
    """Pairs of the largest hashed block, or of all where those fit into one."""
    if table_rows is not None and table_rows <= block_pairs:
        return table_rows
    sizes = sliced.groupBy(bucket(blocks, F.col("id"), F.col("slice")).alias("hashed")).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def _cuts(sliced: DataFrame, blocks: int, block_pairs: int) -> tuple[DataFrame | None, int]:
    """The cuts of blocks with more than ``block_pairs`` pairs, and how many blocks they add.

    Lists are taken in the order of the second hash and cut wherever half a
    block is full; as no list has more than half a block, no piece has more
    than a whole. The driver sees the blocks that are cut, not their lists.
    """
    lists = sliced.groupBy("id", "slice").agg(F.count(F.lit(1)).alias("n"))
    lists = lists.withColumn("hashed", bucket(blocks, F.col("id"), F.col("slice"))).withColumn("place", _order(F.col("slice")))
    over = lists.groupBy("hashed").agg(F.sum("n").alias("pairs")).filter(F.col("pairs") > block_pairs).select("hashed")
    running = Window.partitionBy("hashed").orderBy("place", "id", "slice").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.floor(F.coalesce(F.sum("n").over(running), F.lit(0)) / F.lit(float(max(1, block_pairs // 2))))
    pieces = lists.join(over, "hashed", "left_semi").withColumn("piece", piece)
    edges = pieces.groupBy("hashed", "piece").agg(F.min("place").alias("edge")).filter("piece > 0")
    found = cut_lineage(edges.groupBy("hashed").agg(F.sort_array(F.collect_list("edge")).alias("edges")))
    firsts, added = [], 0
    for row in found.select("hashed", F.size("edges").alias("more")).orderBy("hashed").collect():
        firsts.append((row["hashed"], blocks + added))
        added += row["more"]
    if not firsts:
        return None, 0
    numbered = found.sparkSession.createDataFrame(firsts, "hashed int, first int")
    return cut_lineage(found.join(numbered, "hashed").select("hashed", "first", "edges")), added


def build_layout(
    train: DataFrame,
    by: str,
    of: str,
    blocks: int,
    rows_per_slice: int = ROWS_PER_SLICE,
    table_rows: int | None = None,
    block_pairs: int | None = None,
) -> Layout:
    """Lay the distinct train pairs out by ``by``; one shuffle of the pairs.

    ``block_pairs`` bounds the pairs of every block, provided that no slice has
    more than half of them.

    The block of a pair depends on its two numbers only, so blocks that are
    recomputed after a loss still fit the routes taken from them.
    """
    pairs = train.select(F.col(by).alias("id"), F.col(of).alias("neighbour"))
    heavy = heavy_keys(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "n", rows_per_slice, table_rows)
    partitions = min(blocks, MAX_PARTITIONS)
    sliced = with_slice(pairs, heavy, "id", repeats=False)
    if heavy is None:
        sliced = sliced.withColumn("heavy", F.lit(False))
    else:
        marks = heavy.select("id", F.lit(True).alias("heavy"))
        sliced = sliced.join(marks, "id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    cuts, added = (None, 0)
    if block_pairs is not None and _largest_block(sliced, blocks, table_rows, block_pairs) > block_pairs:
        cuts, added = _cuts(sliced, blocks, block_pairs)
    placed = _placed(sliced, F.col("slice"), blocks, cuts)
    lists = (
        placed.repartitionById(partitions, F.col("block"))
        .groupBy("block", "id", "slice", "heavy")
        .agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))
        .select("block", "id", "heavy", "neighbours")
        .persist()
    )
    return Layout(lists, heavy, blocks + added, partitions, blocks, cuts)


def routes(layout: Layout) -> DataFrame:
    """(id, blocks): the blocks of ``layout`` in which a neighbour's factor row is needed."""
    needed = layout.lists.select("block", F.explode("neighbours").alias("id"))
    # collect_set combines before the shuffle and holds at most one entry per block.
    return needed.groupBy("id").agg(F.collect_set("block").alias("blocks"))
