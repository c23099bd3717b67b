"""Leave-one-out split: each user's latest interaction becomes the test item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.interactions import pair_counts


def last_items(pairs: DataFrame) -> DataFrame:
    """Test table (user_id, item_id) from pairs with ``n`` and ``last_ts``.

    Ties at the latest time go to the larger item number, as frames have no
    input order. Users with a single row get no test item. Partial aggregation
    leaves one row per user and task to shuffle.
    """
    latest = F.max(F.struct(F.col("last_ts"), F.col("item_id"))).alias("_latest")
    per_user = pairs.groupBy("user_id").agg(F.sum("n").alias("_rows"), latest)
    return per_user.filter(F.col("_rows") > 1).select("user_id", F.col("_latest.item_id").alias("item_id"))


def without_test(pairs: DataFrame, test: DataFrame) -> DataFrame:
    """Train table: distinct pairs except every row of a user's test item."""
    return pairs.select("user_id", "item_id").join(test, ["user_id", "item_id"], "left_anti")


def leave_one_out(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of numbered interactions (user_id, item_id, ..., ts)."""
    pairs = pair_counts(interactions, "user_id", "item_id")
    test = last_items(pairs)
    return without_test(pairs, test), test


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row ``leaked``: test pairs that also occur in train (expected 0)."""
    both = test.join(train, ["user_id", "item_id"], "left_semi")
    return both.agg(F.count(F.lit(1)).alias("leaked"))
