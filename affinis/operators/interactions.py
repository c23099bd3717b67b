"""Row-level operators on interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.expressions import is_positive


def binarize(interactions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Keep rows rated strictly above ``threshold`` and set their rating to 1.0."""
    return interactions.filter(is_positive(F.col("rating"), threshold)).withColumn("rating", F.lit(1.0))


def row_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per user or per item, combined before the shuffle."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(rows: DataFrame, user: str = "user_raw", item: str = "item_raw") -> DataFrame:
    """One row per (user, item) with the number of rows and the latest time.

    Everything after the scan works on this table. Repeats are combined before
    the shuffle and the shuffle key is the pair, so neither a busy user nor a
    group of copies can fill a partition.
    """
    return rows.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
