import numpy as np
import pytest

from affinis.operators.matrix import neighbour_lists
from affinis.plans import experiments
from affinis.plans.baseline import baseline_factors, fit_baseline, solved_rows
from affinis.plans.prepare import prepare
from catalog.fixtures import events, prepared_purchases

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return prepared_purchases(spark, FOLDER)


def test_convergence_has_every_iteration_and_metrics_where_asked(data):
    table = experiments.convergence(data, 2, 3, eval_at=lambda n: n == 3).orderBy("iteration").collect()
    assert [row["iteration"] for row in table] == [1, 2, 3]
    assert [row["hr_10"] is None for row in table] == [True, True, False]
    assert table[0]["loss"] > table[2]["loss"]


def test_evaluation_schedule():
    chosen = [n for n in range(1, 21) if experiments.early_and_every(5)(n)]
    assert chosen == [1, 2, 3, 4, 5, 10, 15, 20]


def test_timed_tables_have_times(spark, data):
    assert {"total_time_s", "avg_iter_time_s"} <= set(experiments.k_sweep(data, (2,), 1).columns)
    assert "avg_iter_time_s" in experiments.size_sweep(data, (0.5,), 2, 1).columns
    rows = events(spark, FOLDER)
    assert "load_time_s" in experiments.dataset_sweep([("events", rows, 0.5)], 2, 1).columns


def test_parity_tolerance(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 50.0)], "iteration int, loss double")
    b = spark.createDataFrame([(1, 100.00005), (2, 50.1)], "iteration int, loss double")
    assert [r["matches"] for r in experiments.loss_parity(a, b).orderBy("iteration").collect()] == [True, False]


def test_baseline_fills_unknown_ids_with_zeros(data):
    model = fit_baseline(data.train, 4, 2)
    users, items = baseline_factors(model, data.num_users + 2, data.num_items + 1)
    assert users.count() == data.num_users + 2 and items.count() == data.num_items + 1
    assert items.filter(f"id = {data.num_items}").first()["features"] == [0.0] * 4


def test_neighbour_lists_are_bounded(data):
    parts = neighbour_lists(data.train, "user_id", "item_id", per_list=16).collect()
    assert max(len(row["neighbours"]) for row in parts) <= 16
    pairs = {(row["user_id"], item) for row in parts for item in row["neighbours"]}
    assert len(pairs) == data.train.count()


def test_empty_preparation_runs(spark):
    data = prepare(events(spark, FOLDER), 0.0, 10_000, 10_000)
    assert data.num_users == 0 and data.train.count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_solved_rows_move_the_pairs_three_times(spark, kind):
    rng = np.random.default_rng(3)
    p, q = rng.normal(0, 1, (6, 2)), rng.normal(0, 1, (5, 2)).astype("float32").astype(float)
    pairs = [(u, i) for u in range(6) for i in range(5) if (u + i) % 3]
    system = q.T @ q
    for u in range(5):
        near = q[[i for v, i in pairs if v == u]]
        p[u] = np.linalg.solve(system + 0.01 * len(near) * np.eye(2) + near.T @ near, 2.0 * near.sum(axis=0))
    users, items = (
        spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(side)], f"id long, features array<{kind}>") for side in (p, q)
    )
    train = spark.createDataFrame([pair for pair in pairs for _ in range(2)], "user_id long, item_id long")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        solved = solved_rows(users, items, train, "user_id", "item_id", 2, tolerance=1e-5)
        found = dict(solved.collect())
        plan = solved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert found == {u: u < 5 for u in range(6)}
    # The pairs: once to drop repeats, once to each side; and the two sides.
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 5
