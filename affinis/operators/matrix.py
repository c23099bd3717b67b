"""The user x item matrix as a table of distinct pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Widest range of neighbour numbers held in one list.
NEIGHBOURS_PER_LIST = 65_536


def interaction_matrix(interactions: DataFrame) -> DataFrame:
    """Non-zero cells (user_id, item_id); repeats count once."""
    return interactions.select("user_id", "item_id").distinct()


def matrix_stats(matrix: DataFrame, num_users: int, num_items: int) -> DataFrame:
    """One row: shape, non-zeros and density in percent."""
    cells = F.lit(float(num_users)) * F.lit(float(num_items))
    nnz = F.count(F.lit(1))
    density = F.when(cells > 0, nnz.cast("double") / cells * F.lit(100.0))
    return matrix.agg(
        F.lit(num_users).cast("long").alias("num_users"),
        F.lit(num_items).cast("long").alias("num_items"),
        nnz.alias("nnz"),
        density.alias("density_pct"),
    )


def train_ratings(train: DataFrame) -> DataFrame:
    """Train pairs as (user, item, rating=1.0)."""
    return train.select(
        F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.lit(1.0).alias("rating")
    )


def neighbour_lists(
    train: DataFrame, by: str, of: str, per_list: int = NEIGHBOURS_PER_LIST
) -> DataFrame:
    """(by, part, neighbours): sorted neighbours of each row of the matrix.

    Part p holds the neighbours numbered from ``p * per_list`` on, so no list
    grows beyond ``per_list`` and a busy row is spread over several groups.
    """
    part = F.floor(F.col(of) / F.lit(per_list)).cast("int").alias("part")
    lists = train.groupBy(by, part).agg(F.sort_array(F.collect_list(of)).alias("neighbours"))
    return lists
