"""From raw interactions to train and test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.core import peel
from affinis.operators.interactions import binarize, pair_counts, row_counts
from affinis.operators.numbering import apply_id_map, count_and_number
from affinis.operators.sampling import subsample_users
from affinis.operators.skew import ROWS_PER_SLICE, heavy_keys, skew_join
from affinis.operators.split import last_items, without_test
from affinis.runtime import cut_lineage, cut_lineage_counting
from affinis.sources.interactions import scan_reviews


@dataclass(frozen=True)
class Prepared:
    """Pair tables (user_id, item_id), id maps (raw, number) and the matrix shape."""

    train: DataFrame
    test: DataFrame
    full: DataFrame
    user_map: DataFrame
    item_map: DataFrame
    num_users: int
    num_items: int


def prepare(
    interactions: DataFrame,
    rating_threshold: float = 0.0,
    min_user_interactions: int = 10,
    min_item_interactions: int = 10,
    subsample_frac: float = 1.0,
    seed: int = 42,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Prepared:
    """Threshold, core filter, optional user sample, numbering and leave-one-out split.

    The rows are read and shuffled once, combined to one row per pair with its
    count and latest time; every later step works on that table. The core is
    found from degree tables alone, and the joins that number the pairs drop
    those outside it. Identifiers are numbered once, at the end: numbering keeps
    the order, so this equals renumbering after each step. Without any filter or
    sample the matrix also has rows and columns for identifiers that only occur
    below the threshold.
    """
    pairs, table_rows = cut_lineage_counting(pair_counts(binarize(interactions, rating_threshold)))
    filtered = min_user_interactions > 0 or min_item_interactions > 0
    sampled = subsample_frac < 1.0
    heavy_users = heavy_items = None
    if filtered:
        sides = peel(
            pairs, "user_raw", "item_raw", min_user_interactions, min_item_interactions, rows_per_slice, table_rows
        )
        users, items = (side.survivors() for side in sides)
        # Counted once, over all pairs; what is left of a key never needs more slices.
        heavy_users, heavy_items = ((side.heavy,) for side in sides)
    else:
        universe = pairs if sampled else interactions
        users, items = (universe.select(raw).distinct() for raw in ("user_raw", "item_raw"))
    if sampled:
        users = subsample_users(users, subsample_frac, seed)
    user_map, num_users = count_and_number(users, "user_raw", "user_id")
    numbered = apply_id_map(pairs, user_map, "user_raw", rows_per_slice, table_rows, heavy_users)
    if sampled:
        # The sample may leave items of the core without any row.
        heavy = heavy_items[0] if heavy_items else heavy_keys(row_counts(numbered, "item_raw"), "item_raw", "n", rows_per_slice, table_rows)
        numbered = cut_lineage(skew_join(numbered, items, "item_raw", "left_semi", heavy))
        items = numbered.select("item_raw").distinct()
    item_map, num_items = count_and_number(items, "item_raw", "item_id")
    numbered = cut_lineage(apply_id_map(numbered, item_map, "item_raw", rows_per_slice, table_rows, heavy_items))
    test = cut_lineage(last_items(numbered))
    return Prepared(
        train=cut_lineage(without_test(numbered, test)),
        test=test,
        full=numbered.select("user_id", "item_id"),
        user_map=user_map,
        item_map=item_map,
        num_users=num_users,
        num_items=num_items,
    )


def load_and_prepare(spark: SparkSession, path: str, **options) -> Prepared:
    """``prepare`` on a JSON-lines review file."""
    return prepare(scan_reviews(spark, path), **options)


def prepare_summary(prepared: Prepared) -> DataFrame:
    """One row of sizes: users, items, matrix cells, train pairs, test users, leaked pairs."""
    leaked = prepared.test.join(prepared.train, ["user_id", "item_id"], "left_semi")
    parts = {"full_nnz": prepared.full, "train_nnz": prepared.train, "test_users": prepared.test, "leaked": leaked}
    marked = [
        frame.select(*[F.lit(int(name == part)).cast("long").alias(name) for name in parts])
        for part, frame in parts.items()
    ]
    rows = marked[0].unionAll(marked[1]).unionAll(marked[2]).unionAll(marked[3])
    return rows.agg(
        F.lit(prepared.num_users).cast("long").alias("num_users"),
        F.lit(prepared.num_items).cast("long").alias("num_items"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts],
    )
