"""Dense 0-based numbering of identifiers in their sort order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.interactions import row_counts
from affinis.operators.skew import ROWS_PER_SLICE, heavy_keys, skew_join
from affinis.runtime import cut_lineage

# monotonically_increasing_id() keeps the partition above these bits.
_ROW_BITS = 33


def number_ids(rows: DataFrame, raw: str, number: str) -> DataFrame:
    """(raw, number): rank of each distinct ``raw`` value, starting at 0."""
    return count_and_number(rows.select(raw).distinct(), raw, number)[0]


def count_and_number(distinct_values: DataFrame, raw: str, number: str) -> tuple[DataFrame, int]:
    """Number the values of a column without repeats; returns the map and its size.

    The values are range-partitioned and sorted, which numbers them inside
    their partition; one count per partition then gives the offsets. Nothing is
    sorted or counted in one task. The sorted table is cut from its lineage
    because range bounds are sampled and could move if it were recomputed.
    """
    ordered = distinct_values.select(raw).orderBy(raw)
    place = cut_lineage(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    sizes = place.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).orderBy("_part").collect()
    offsets, total = [], 0
    for size in sizes:
        offsets.append((size["_part"], total))
        total += size["_size"]
    # One row per shuffle partition, so the broadcast is bounded by the partition count.
    offset_table = place.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    id_map = (
        place.withColumn("_part", part)
        .join(F.broadcast(offset_table), "_part")
        .select(raw, (F.col("_offset") + within).alias(number))
    )
    return id_map, total


def apply_id_map(
    rows: DataFrame,
    id_map: DataFrame,
    raw: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    table_rows: int | None = None,
    counted: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """Replace ``raw`` by its number; rows without a number are dropped.

    ``counted`` wraps the heavy keys (or None for none) where they are known
    from counts of these rows or of more; otherwise the rows are counted.
    """
    heavy = counted[0] if counted else heavy_keys(row_counts(rows, raw), raw, "n", rows_per_slice, table_rows)
    return skew_join(rows, id_map, raw, "inner", heavy).drop(raw)


def reindex(
    interactions: DataFrame, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered interactions, user map, item map) over all identifiers present.

    The source is read once and written as a table; the steps read that.
    """
    interactions = cut_lineage(interactions)
    users = number_ids(interactions, "user_raw", "user_id")
    items = number_ids(interactions, "item_raw", "item_id")
    numbered = apply_id_map(interactions, users, "user_raw", rows_per_slice)
    numbered = apply_id_map(numbered, items, "item_raw", rows_per_slice)
    return numbered.select("user_id", "item_id", "rating", "ts"), users, items


def compose_id_maps(first: DataFrame, second: DataFrame, raw: str, number: str, new_number: str) -> DataFrame:
    """(raw, new_number) from (raw, number) and (number, new_number).

    Both maps are one-to-one, so no key is heavy.
    """
    return first.join(second, number).select(raw, new_number)
