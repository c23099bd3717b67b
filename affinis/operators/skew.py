"""Joins that stay balanced when single keys hold a large share of the rows.

A key is *heavy* when it has more than ``rows_per_slice`` rows. Its rows are
spread over slices of about that many, and the other side's row is repeated once
per slice. Every heavy key is sliced, however many there are. The table of heavy
keys is broadcast while its counted bytes stay below a bound and joined by
shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.runtime import cut_lineage

# Counted bytes of keys and numbers up to which a table is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
_NUMBER_BYTES = 16
# Below this many rows a key never needs slicing.
ROWS_PER_SLICE = 1_000_000
# A lookup of counted size is broadcast up to this many rows, shuffled beyond.
BROADCAST_ROWS = 200_000


def broadcast_within(table: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """``table``, marked for broadcast if its keys and one number each fit in BROADCAST_BYTES."""
    size = F.octet_length(F.col(key).cast("string")) if dict(table.dtypes)[key] in ("string", "binary") else F.lit(8)
    total = table.agg(F.coalesce(F.sum(size + F.lit(_NUMBER_BYTES)), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= (BROADCAST_BYTES if limit is None else limit) else table


def heavy_keys(
    degrees: DataFrame,
    key: str,
    rows: str = "n",
    rows_per_slice: int = ROWS_PER_SLICE,
    table_rows: int | None = None,
) -> DataFrame | None:
    """(key, slices) of the heavy keys, or None when there are none.

    ``degrees`` holds one row per key with its row count, the result of a
    partially aggregated groupBy. A table known to have no more rows than one
    slice (``table_rows``) has no heavy key and is not looked at.
    """
    if table_rows is not None and table_rows <= rows_per_slice:
        return None
    largest = degrees.agg(F.max(rows)).first()[0]
    if largest is None or largest <= rows_per_slice:
        return None
    slices = F.ceil(F.col(rows) / F.lit(float(rows_per_slice))).cast("int")
    heavy = cut_lineage(degrees.filter(F.col(rows) > rows_per_slice).select(key, slices.alias("slices")))
    return broadcast_within(heavy, key)


def with_slice(facts: DataFrame, heavy: DataFrame | None, key: str, repeats: bool = True) -> DataFrame:
    """Add a ``slice`` number: 0 for light keys, spread evenly for heavy ones.

    Rows spread by a hash of their columns. If the table may hold exact copies
    (``repeats``), the partition number joins the hash so that copies spread
    too; a retried task sees the same partition number again.
    """
    if heavy is None:
        return facts.withColumn("slice", F.lit(0))
    seeds = [F.col(c) for c in facts.columns] + ([F.spark_partition_id()] if repeats else [])
    tagged = facts.join(heavy, key, "left")
    spread = F.pmod(F.xxhash64(*seeds), F.col("slices")).cast("int")
    return tagged.withColumn("slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(spread)).drop("slices")


def skew_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str,
    heavy: DataFrame | None,
    lookup_rows: int | None = None,
) -> DataFrame:
    """Join ``facts`` with a ``lookup`` that is unique on ``key``.

    ``how`` is inner, left, left_semi or left_anti. ``lookup_rows`` is the
    counted size of the lookup where the caller knows it; one of few rows and
    bytes is broadcast, which leaves the facts where they are.
    """
    columns = list(facts.columns)
    if how in ("inner", "left"):
        columns += [name for name in lookup.columns if name != key]
    if lookup_rows is not None and lookup_rows <= BROADCAST_ROWS:
        return facts.join(broadcast_within(lookup, key), key, how).select(columns)
    if heavy is None:
        return facts.join(lookup, key, how).select(columns)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1))
    fanned = lookup.join(heavy, key, "left").withColumn("slice", copies).drop("slices")
    return with_slice(facts, heavy, key).join(fanned, [key, "slice"], how).select(columns)
