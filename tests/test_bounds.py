"""Bounds that hold whatever the data: sliced keys, ties, empty and null input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import blocks, ranking, skew
from affinis.operators.blocks import build_layout
from affinis.plans import baseline, experiments
from affinis.plans.prepare import prepare
from affinis.plans.training import eals_train, eals_train_uniform
from affinis.sources.interactions import scan_interactions
from catalog.fixtures import prepared_purchases

FOLDER = "/root/testdata/sf0.001"
ROWS = "user_raw string, item_raw string, rating double, ts long"


@pytest.mark.parametrize("sent", [32 * 1024 * 1024, 0])
def test_every_key_above_a_slice_is_sliced(spark, monkeypatch, sent):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", sent)
    pairs = spark.range(60 * 200).select((F.col("id") % 60).alias("user_id"), F.floor(F.col("id") / 60).alias("item_id"))
    layout = build_layout(pairs, "user_id", "item_id", 8, rows_per_slice=20)
    assert layout.heavy.count() == 60
    sizes = [r.n for r in layout.lists.select(F.size("neighbours").alias("n")).collect()]
    # Slices are dealt by hash: about ten of twenty for each of the sixty keys.
    assert sum(sizes) == 60 * 200 and max(sizes) < 60 and np.mean(sizes) < 25
    lookup = spark.range(60).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("twice"))
    joined = skew.skew_join(pairs, lookup, "user_id", "inner", layout.heavy.withColumnRenamed("id", "user_id"))
    assert joined.count() == 60 * 200 and joined.filter("twice <> 2 * user_id").count() == 0
    layout.unpersist()


def test_no_block_exceeds_its_bound(spark):
    pairs = spark.range(300 * 20).select((F.col("id") % 300).alias("user_id"), F.floor(F.col("id") / 300).alias("item_id"))
    layout = build_layout(pairs, "user_id", "item_id", 100, rows_per_slice=30, block_pairs=60)
    sizes = [r.n for r in layout.lists.groupBy("block").agg(F.sum(F.size("neighbours")).alias("n")).collect()]
    assert sum(sizes) == 300 * 20 and max(sizes) <= 60 and layout.cuts is not None
    homes = layout.placed(spark.range(300).select("id"), F.lit(0))
    met = layout.lists.join(homes, "id").filter(layout.lists["block"] != homes["block"])
    assert met.count() == 0 and homes.count() == 300
    layout.unpersist()


def test_blocks_of_rows_of_few_pairs_need_no_cuts(spark):
    """With blocks filled to the bound on average, hashing overfills half of them."""
    pairs = spark.range(20_000 * 10).select((F.col("id") % 20_000).alias("user_id"), F.floor(F.col("id") / 20_000).alias("item_id"))
    block_bytes = 20_000 * (8 * (8 + 1) + 64)
    count, bound = blocks.block_count(200_000, 8, 1, block_bytes), blocks.pairs_per_block(8, block_bytes)
    layout = build_layout(pairs, "user_id", "item_id", count, table_rows=200_000, block_pairs=bound)
    assert bound == 20_000 and layout.cuts is None and layout.blocks <= 13
    layout.unpersist()


def test_blocks_of_the_baseline_grow_with_the_pairs_and_stay_on_disk(spark, monkeypatch):
    data, given, plain = prepared_purchases(spark, FOLDER), [], baseline.ALS
    monkeypatch.setattr(baseline, "ALS", lambda **settings: given.append(settings) or plain(**settings))
    monkeypatch.setattr(baseline, "BLOCK_PAIRS", 100)
    model = baseline.fit_baseline(data.train, 2, 1)
    assert model.userFactors.count() == data.train.select("user_id").distinct().count()
    assert given[0]["numUserBlocks"] == given[0]["numItemBlocks"] == -(-data.train.count() // 100) > 10
    assert given[0]["intermediateStorageLevel"] == "DISK_ONLY"


def test_rows_without_ids_are_no_interactions(spark):
    rows = [(None, "a", 5.0, 1), ("u", None, 5.0, 2), (None, None, 5.0, 3), ("u", "a", 5.0, 4), ("v", "b", 5.0, 5), ("v", "a", 5.0, 6)]
    scanned = scan_interactions(spark.createDataFrame(rows, ROWS), "user_raw", "item_raw", "rating", "ts")
    data = prepare(scanned, min_user_interactions=0, min_item_interactions=0)
    assert (data.num_users, data.num_items) == (2, 2)
    assert {(r.user_raw, r.user_id) for r in data.user_map.collect()} == {("u", 0), ("v", 1)}


def test_training_of_nothing(spark):
    data = prepare(spark.createDataFrame([], ROWS))
    assert (data.num_users, data.num_items) == (0, 0)
    for train, options in ((eals_train, {"K": 2}), (eals_train_uniform, {"num_factors": 2})):
        model = train(data.train, 0, 0, num_iter=1, **options)
        assert model.losses == [0.0] and model.user_factors.count() == 0
    assert eals_train(data.train, 0, 0, K=2, num_iter=0).final_loss is None
    table = experiments.k_sweep(data, (2,), 1, timed=False)
    assert table.columns == ["k", "hr_5", "hr_10", "hr_20", "ndcg_10", "final_loss"] and table.first().hr_5 is None
    assert experiments.k_sweep(data, (), 1, timed=False).columns == table.columns


def test_zero_vectors_rank_by_item_number(spark):
    items = 300
    users = spark.createDataFrame([(n, [0.0, 0.0] if n < 3 else [1.0, 2.0]) for n in range(5)], "id long, features array<double>")
    things = spark.createDataFrame([(n, [float(n % 4), 1.0]) for n in range(items)], "id long, features array<double>")
    train = spark.createDataFrame([(0, 0), (0, 2), (1, 5), (3, 3)], "user_id long, item_id long")
    test = spark.createDataFrame([(0, 4), (1, 1), (2, 299), (3, 7), (4, 0)], "user_id long, item_id long")
    found = {r.user_id: r["rank"] for r in ranking.held_out_ranks(users, things, train, test, 2).collect()}
    # Users 0-2 rank all unseen items by number; for the others items n % 4 = 3 come first.
    assert found == {0: 3, 1: 2, 2: 300, 3: 1, 4: 226}
    best = ranking.recommend(users, things, train, 2, 3).orderBy("user_id", "position").collect()
    assert [r.item_id for r in best if r.user_id == 0] == [1, 3, 4]
    assert [r.item_id for r in best if r.user_id == 3] == [7, 11, 15]


def test_close_cells_are_gathered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_GATHER_BYTES", 64)
    users = spark.createDataFrame([(0, [0.1, 0.3])], "id long, features array<double>")
    things = spark.createDataFrame([(n, [0.3, 0.1]) for n in range(200)], "id long, features array<double>")
    none = spark.createDataFrame([], "user_id long, item_id long")
    test = spark.createDataFrame([(0, 150)], "user_id long, item_id long")
    assert ranking.held_out_ranks(users, things, none, test, 2).first()["rank"] == 151


def test_baseline_metrics_and_equations(spark):
    data = prepared_purchases(spark, FOLDER)
    table = {r.method: r for r in experiments.baseline_comparison(data, 8, 5).collect()}
    assert set(table) == {"elementwise", "mllib"}
    for row in table.values():
        assert 0 <= row.hr_5 <= row.hr_10 <= row.hr_20 <= 1
    model = baseline.fit_baseline(data.train, 8, 5)
    assert baseline.solves_normal_equations(model, data.train).filter("NOT solved").count() == 0
    assert baseline.solves_normal_equations(model, data.train, reg=5.0).filter("solved").count() == 0


def test_a_block_is_bounded_by_whole_rows_not_by_vectors():
    """With two factors the other columns of a mailed row take several times what its vector does."""
    from affinis.operators import blocks

    for rank in (2, 8, 128):
        assert blocks.pairs_per_block(rank) * (8 * (rank + 1) + 64) <= blocks.BLOCK_BYTES
    assert blocks.block_count(216_000_000, 2, 12) >= 70
