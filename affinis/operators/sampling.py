"""Exact-size, repeatable samples of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.expressions import sampling_key
from affinis.operators.numbering import apply_id_map, number_ids
from affinis.operators.skew import ROWS_PER_SLICE

# Key digits fixed per refinement step: at most 16**4 counts reach the driver.
_DIGITS = 4
_KEY_LENGTH = 32
# A group of keys this small is ordered directly.
_SMALL_GROUP = 4096


def sample_size(population: int, fraction: float) -> int:
    return max(1, int(population * fraction))


def smallest_keys(users: DataFrame, user: str, size: int, seed: int) -> Column:
    """Condition on ``user`` that holds for the ``size`` smallest sampling keys.

    The boundary is found by counting keys per leading digits, then refining
    inside the one group that contains it. Users are neither sorted nor moved,
    and the result is a plain filter, applicable to any table with the column.
    """
    key = sampling_key(F.col(user), seed)
    keyed = users.select(user, key.alias("_key")).persist()
    prefix, wanted, group_size = "", size, None
    while len(prefix) < _KEY_LENGTH and (group_size is None or group_size > _SMALL_GROUP):
        length = len(prefix) + _DIGITS
        counts = (
            keyed.filter(F.col("_key").startswith(prefix))
            .groupBy(F.substring("_key", 1, length).alias("_prefix"))
            .count()
            .orderBy("_prefix")
            .collect()
        )
        for row in counts:
            if row["count"] >= wanted:
                prefix, group_size = row["_prefix"], row["count"]
                break
            wanted -= row["count"]
        else:
            keyed.unpersist()
            return F.lit(True)
    edge = keyed.filter(F.col("_key").startswith(prefix)).orderBy("_key", user).limit(wanted)
    last = edge.orderBy(F.desc("_key"), F.desc(user)).first()
    keyed.unpersist()
    same = (key == F.lit(last["_key"])) & (F.col(user) <= F.lit(last[user]))
    return (key < F.lit(last["_key"])) | same


def subsample_users(rows: DataFrame, fraction: float, seed: int = 42, user: str = "user_raw") -> DataFrame:
    """All rows of exactly ``max(1, int(n * fraction))`` of the n users in ``rows``."""
    users = rows.select(user).distinct().persist()
    size = sample_size(users.count(), fraction)
    condition = smallest_keys(users, user, size, seed)
    users.unpersist()
    return rows.filter(condition)


def subsample_matrix(
    train: DataFrame, num_users: int, fraction: float, seed: int = 42, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, int, int]:
    """(train pairs, users, items) for a share of the matrix rows.

    Users without train pairs belong to the population and keep their row;
    items left without pairs lose their column. Both sides are renumbered.
    """
    population = train.sparkSession.range(num_users).select(F.col("id").alias("user_id"))
    size = sample_size(num_users, fraction)
    condition = smallest_keys(population, "user_id", size, seed)
    kept = train.filter(condition)
    users = number_ids(population.filter(condition), "user_id", "_user")
    items = number_ids(kept, "item_id", "_item")
    numbered = apply_id_map(kept, users, "user_id", rows_per_slice)
    numbered = apply_id_map(numbered, items, "item_id", rows_per_slice)
    pairs = numbered.select(F.col("_user").alias("user_id"), F.col("_item").alias("item_id"))
    return pairs, min(size, num_users), items.count()
