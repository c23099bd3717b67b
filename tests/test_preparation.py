import datetime
import random

import pytest
from pyspark.sql import functions as F

from affinis.operators.core import core_filter
from affinis.operators.interactions import binarize
from affinis.operators.numbering import number_ids, reindex
from affinis.operators.sampling import subsample_matrix, subsample_users
from affinis.operators.skew import heavy_keys, skew_join
from affinis.operators.split import leakage, leave_one_out
from affinis.operators.weights import item_weights
from affinis.plans.prepare import prepare, prepare_summary
from brute import core

RAW = "user_raw string, item_raw string, rating double, ts timestamp_ntz"
NUMBERED = "user_id long, item_id long, rating double, ts timestamp_ntz"


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def skewed_rows(count=600, seed=3):
    """One user and one item hold a third of the rows each; copies included."""
    pick = random.Random(seed)
    rows = []
    for n in range(count):
        user = "hot" if n % 3 == 0 else f"u{pick.randrange(40)}"
        item = "hit" if n % 3 == 1 else f"i{pick.randrange(60)}"
        rows.append((user, item, 1.0, at(pick.randrange(50))))
    return rows + [("hot", "hit", 1.0, at(0))] * 50


def test_threshold_is_strict_and_drops_nan_and_null(spark):
    rows = [("a", "x", 3.0, at(0)), ("a", "y", 3.5, at(0)), ("b", "x", float("nan"), at(0)), ("b", "y", None, at(0))]
    kept = binarize(spark.createDataFrame(rows, RAW), 3.0).collect()
    assert [(r["user_raw"], r["item_raw"], r["rating"]) for r in kept] == [("a", "y", 1.0)]


@pytest.mark.parametrize("minimums", [(5, 0), (0, 6), (8, 9), (15, 12), (500, 500), (0, 0)])
@pytest.mark.parametrize("rows_per_slice", [1_000_000, 20])
def test_core_equals_brute_force(spark, minimums, rows_per_slice):
    rows = skewed_rows()
    kept = core_filter(spark.createDataFrame(rows, RAW).repartition(3), *minimums, rows_per_slice=rows_per_slice)
    assert sorted(map(tuple, kept.collect())) == sorted(core(rows, *minimums))


def test_core_follows_long_chains_and_is_idempotent(spark):
    """A path graph loses its ends one step at a time."""
    rows = []
    for n in range(12):
        rows += [(f"u{n:02}", f"i{n:02}", 1.0, at(0)), (f"u{n:02}", f"i{n + 1:02}", 1.0, at(0))]
    rows += [(u, i, 1.0, at(0)) for u in ("a", "b") for i in ("x", "y")]
    kept = core_filter(spark.createDataFrame(rows, RAW), 2, 2)
    assert sorted(map(tuple, kept.collect())) == sorted(core(rows, 2, 2))
    assert core_filter(kept, 2, 2).count() == 4


@pytest.mark.parametrize("named, few", [(1000, 100_000), (0, 100_000), (1, 1), (5, 3)])
def test_core_by_joins_and_by_names(spark, monkeypatch, named, few):
    """The same core whether steps are joins, few keys at a time, or change between the two."""
    from affinis.operators import core as module
    from affinis.operators import keyed

    for place in (module, keyed):
        monkeypatch.setattr(place, "NAMED_KEYS", named)
    monkeypatch.setattr(module, "FEW_PAIRS", few)
    pick = random.Random(2)
    rows = [(f"u{pick.randrange(30)}", f"i{pick.randrange(25)}", 1.0, at(0)) for _ in range(140)]
    rows += [(f"c{n}", f"d{n + side}", 1.0, at(0)) for n in range(6) for side in (0, 1)]
    frame = spark.createDataFrame(rows, RAW)
    for minimums in ((4, 5), (5, 0), (2, 2)):
        assert sorted(map(tuple, core_filter(frame, *minimums).collect())) == sorted(core(rows, *minimums))


def test_core_reads_little_of_a_chain(spark):
    """A chain falls apart key by key beside a large stable part; a step reads the folders of its keys only."""
    from affinis.operators.core import peel

    steps = 20
    chain = [(10_000 + n, 10_000 + n + side, 1) for n in range(steps) for side in (0, 1)]
    stable = [(u, i, 1) for u in range(200) for i in range(20)]
    pairs = spark.createDataFrame(chain + stable, "user_raw long, item_raw long, n long").persist()
    users, items = peel(pairs, "user_raw", "item_raw", 2, 2, 1_000_000, len(chain + stable), rows_per_folder=100)
    assert users.survivors().count() == 200 and items.survivors().count() == 20
    dropped = users.state.filter("dropped_in IS NOT NULL").count() + items.state.filter("dropped_in IS NOT NULL").count()
    read = users.rows_read + items.rows_read
    # Every step that reads the whole table would come to steps * len(pairs) rows.
    assert dropped == 2 * steps + 1 and read <= dropped * 400 and read < steps * len(chain + stable) / 3


def test_core_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    from affinis.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rows = skewed_rows()
    kept = core_filter(spark.createDataFrame(rows, RAW), 8, 9, rows_per_slice=20)
    assert sorted(map(tuple, kept.collect())) == sorted(core(rows, 8, 9))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sliced_join_equals_plain_join(spark, how):
    facts = spark.createDataFrame([("hot" if n % 3 else f"k{n % 7}", n // 40) for n in range(300)], "k string, v int")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "k string, w int")
    heavy = heavy_keys(facts.groupBy("k").count(), "k", "count", rows_per_slice=25)
    assert [r["k"] for r in heavy.collect()] == ["hot"]
    found = skew_join(facts.repartition(5), lookup, "k", how, heavy)
    assert sorted(found.collect()) == sorted(facts.join(lookup, "k", how).collect())


def test_numbers_follow_the_sort_order(spark):
    names = ["z", "é", "e", "Z", "😀", "a b", "", "10", "9", "ß"] + [f"n{n}" for n in range(500)]
    frame = spark.createDataFrame([(n,) for n in names * 2], "raw string").repartition(7)
    numbers = {r["raw"]: r["number"] for r in number_ids(frame, "raw", "number").collect()}
    assert numbers == {name: n for n, name in enumerate(sorted(names))}


def test_numbering_nothing(spark):
    assert number_ids(spark.createDataFrame([], "raw string"), "raw", "number").count() == 0


def test_reindex_with_hot_keys(spark):
    rows = skewed_rows()
    numbered, users, items = reindex(spark.createDataFrame(rows, RAW), rows_per_slice=20)
    user, item = ({r[0]: r[1] for r in m.collect()} for m in (users, items))
    assert sorted(map(tuple, numbered.collect())) == sorted((user[u], item[i], r, t) for u, i, r, t in rows)


@pytest.mark.parametrize("fraction", [0.0001, 0.25, 0.5, 0.999, 1.0])
def test_sample_has_the_exact_size_under_any_partitioning(spark, fraction):
    frame = spark.range(20000).selectExpr("concat('user', id % 7001) AS user_raw", "id AS item_raw")
    first = {r[0] for r in subsample_users(frame, fraction).select("user_raw").distinct().collect()}
    again = {r[0] for r in subsample_users(frame.repartition(11), fraction).select("user_raw").distinct().collect()}
    assert len(first) == max(1, int(7001 * fraction)) and first == again
    rows = subsample_users(frame, fraction)
    assert rows.count() == frame.filter(frame.user_raw.isin(sorted(first))).count()


def test_sampling_nobody(spark):
    assert subsample_users(spark.createDataFrame([], "user_raw string"), 0.5).count() == 0


def test_matrix_sample_keeps_empty_rows_and_drops_empty_columns(spark):
    train = spark.createDataFrame([(0, 0), (1, 5), (2, 9), (0, 9)], "user_id long, item_id long")
    pairs, users, items = subsample_matrix(train, 6, 1.0)
    assert (users, items) == (6, 3)
    assert sorted(map(tuple, pairs.collect())) == [(0, 0), (0, 2), (1, 1), (2, 2)]
    _, users, _ = subsample_matrix(train, 6, 0.5)
    assert users == 3


def test_split_edge_cases(spark):
    rows = [
        (0, 1, 1.0, at(5)),  # a single row stays in train
        (1, 2, 1.0, at(1)), (1, 2, 1.0, at(2)),  # only one item: tested, no train row
        (2, 3, 1.0, at(1)), (2, 4, 1.0, at(2)), (2, 3, 1.0, at(3)),  # earlier repeat of the test item
        (3, 7, 1.0, at(4)), (3, 5, 1.0, at(4)), (3, 6, 1.0, at(1)),  # tie at the latest time
        (4, 8, 1.0, at(1)), (4, 8, 1.0, at(1)), (4, 9, 1.0, at(2)),  # repeated train row
    ]
    train, test = leave_one_out(spark.createDataFrame(rows, NUMBERED))
    assert sorted(map(tuple, test.collect())) == [(1, 2), (2, 3), (3, 7), (4, 9)]
    assert sorted(map(tuple, train.collect())) == [(0, 1), (2, 4), (3, 5), (3, 6), (4, 8)]
    assert leakage(train, test).first()["leaked"] == 0


def test_weights_sum_and_zero_counts(spark):
    train = spark.createDataFrame([(0, 0), (1, 0), (0, 2)], "user_id long, item_id long")
    popular = {r["item_id"]: r["c"] for r in item_weights(train, 4, 8.0, 0.4).collect()}
    assert sum(popular.values()) == pytest.approx(8.0) and popular[1] == 0.0
    uniform = {r["item_id"]: r["c"] for r in item_weights(train, 4, 8.0, 0.0).collect()}
    assert uniform == {n: 2.0 for n in range(4)}


def test_weights_read_the_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pairs = spark.range(60).select((F.col("id") % 20).alias("user_id"), (F.col("id") % 7).alias("item_id"))
    weights = item_weights(pairs.mapInArrow(counting, pairs.schema), 9, 8.0, 0.4).collect()
    assert read.value == 60
    assert sum(row["n"] for row in weights) == 60
    assert len(weights) == 9


def test_prepare_with_hot_keys(spark):
    rows = skewed_rows()
    data = prepare(spark.createDataFrame(rows, RAW), 0.0, 8, 9, rows_per_slice=20)
    kept = core(rows, 8, 9)
    assert data.num_users == len({r[0] for r in kept}) and data.num_items == len({r[1] for r in kept})
    assert data.full.count() == len({(r[0], r[1]) for r in kept})
    assert prepare_summary(data).first()["leaked"] == 0


def test_unfiltered_shape_keeps_ids_below_the_threshold(spark):
    rows = [("a", "x", 5.0, at(0)), ("a", "y", 5.0, at(1)), ("b", "z", 1.0, at(2))]
    data = prepare(spark.createDataFrame(rows, RAW), 2.0, 0, 0)
    assert (data.num_users, data.num_items, data.full.count()) == (2, 3, 2)


def test_everything_filtered_out(spark):
    data = prepare(spark.createDataFrame(skewed_rows(), RAW), 0.0, 10_000, 10_000)
    summary = prepare_summary(data).first()
    assert (summary["num_users"], summary["train_nnz"], summary["test_users"]) == (0, 0, 0)
