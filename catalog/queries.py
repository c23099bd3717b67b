"""One query per operator: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import blocks, core, factors, halfstep, interactions, loss, matrix, numbering, ranking
from affinis.operators import sampling, split, weights
from affinis.plans import baseline, experiments, relational, training
from affinis.plans.prepare import Prepared, prepare
from affinis.plans.prepare import prepare_summary as summary_of
from affinis.runtime import GenerationStore, checkpoint_root
from affinis.sources import sinks
from affinis.sources.interactions import scan_embedded_json, scan_reviews
from catalog.fixtures import events, prepared_purchases, purchases, start_factors

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

RANK = 2
ITERATIONS = 2


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _start(spark: SparkSession, data: Prepared, rank: int = RANK) -> tuple[DataFrame, DataFrame]:
    return start_factors(spark, data.num_users, data.num_items, rank)


def _flat(factor_table: DataFrame, side: str, rank: int = RANK, digits: int = 6) -> DataFrame:
    values = [F.round(F.col("features")[f], digits).alias(f"f{f}") for f in range(rank)]
    return factor_table.select(F.lit(side).alias("side"), "id", *values)


def _both(model: training.FactorModel) -> DataFrame:
    return _flat(model.user_factors, "user").unionAll(_flat(model.item_factors, "item"))


# Scans, filters and counts


@query
def scan_interactions(spark, folder):
    return purchases(spark, folder)


@query
def scan_json_interactions(spark, folder):
    return events(spark, folder).withColumn("ts_s", F.unix_timestamp(F.col("ts").cast("timestamp"))).drop("ts")


@query
def scan_review_files(spark, folder):
    """The purchases written as JSON lines, read back through the review scan."""
    path = f"{checkpoint_root(spark)}/reviews-{uuid.uuid4().hex}"
    purchases(spark, folder).select(
        F.col("user_raw").cast("string").alias("user_id"),
        F.col("item_raw").cast("string").alias("business_id"),
        F.col("rating").alias("stars"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
    ).write.json(path)
    return scan_reviews(spark, path)


@query
def scan_null_ids(spark, folder):
    """Events of which some name no item and some no user; such rows are no interactions."""
    table = spark.read.parquet(f"{folder}/events.parquet")
    table = table.withColumn("props", F.when(F.col("event_id") % 5 != 0, F.col("props")))
    table = table.withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    rows = scan_embedded_json(table, "user_id", "props", "$.k", "bigint", "value", "ts")
    return numbering.reindex(rows)[0].select("user_id", "item_id", "rating")


def _round_trip(spark, folder, kind, write, read):
    """Counts per customer written by a sink and read back."""
    path = f"{checkpoint_root(spark)}/sink-{kind}-{uuid.uuid4().hex}"
    rows = interactions.row_counts(purchases(spark, folder), "user_raw")
    many = F.when(F.col("n") > 20, F.concat(F.lit('more, than "20" of '), F.col("user_raw")))
    write(rows.withColumn("note", many), path)
    return read("user_raw long, n long, note string", path)


@query
def sink_csv(spark, folder):
    def read(schema, path):
        return spark.read.schema(schema).csv(path, header=True, escape="\"")

    return _round_trip(spark, folder, "csv", sinks.write_csv, read)


@query
def sink_json(spark, folder):
    return _round_trip(spark, folder, "json", sinks.write_json, lambda schema, path: spark.read.schema(schema).json(path))


@query
def binarize(spark, folder):
    return interactions.binarize(purchases(spark, folder), 25.0)


@query
def user_counts(spark, folder):
    return interactions.row_counts(purchases(spark, folder), "user_raw")


@query
def item_counts(spark, folder):
    return interactions.row_counts(purchases(spark, folder), "item_raw")


@query
def core_filter(spark, folder):
    return core.core_filter(interactions.binarize(purchases(spark, folder), 25.0), 10, 10)


# Numbering and sampling


@query
def user_index(spark, folder):
    return numbering.number_ids(purchases(spark, folder), "user_raw", "user_id")


@query
def item_index(spark, folder):
    return numbering.number_ids(purchases(spark, folder), "item_raw", "item_id")


@query
def reindexed_interactions(spark, folder):
    return numbering.reindex(purchases(spark, folder))[0]


@query
def id_map_compose(spark, folder):
    """Raw user -> number among all -> number among users with a rating above 49."""
    rows, users, _ = numbering.reindex(purchases(spark, folder))
    kept = numbering.number_ids(interactions.binarize(rows, 49.0), "user_id", "kept_id")
    return numbering.compose_id_maps(users, kept, "user_raw", "user_id", "kept_id")


@query
def subsample_users(spark, folder):
    return sampling.subsample_users(purchases(spark, folder), 0.25)


@query
def subsample_matrix(spark, folder):
    data = prepared_purchases(spark, folder)
    return sampling.subsample_matrix(data.train, data.num_users, 0.25)[0]


# Matrix and split


def _numbered_events(spark, folder):
    return numbering.reindex(events(spark, folder))[0]


@query
def interaction_matrix(spark, folder):
    return matrix.interaction_matrix(_numbered_events(spark, folder))


@query
def matrix_stats(spark, folder):
    rows, users, items = numbering.reindex(events(spark, folder))
    stats = matrix.matrix_stats(matrix.interaction_matrix(rows), users.count(), items.count())
    return stats.withColumn("density_pct", F.round("density_pct", 9))


@query
def train_ratings(spark, folder):
    return matrix.train_ratings(prepared_purchases(spark, folder).train)


@query
def neighbour_lists(spark, folder):
    cells = matrix.interaction_matrix(_numbered_events(spark, folder))
    lists = matrix.neighbour_lists(cells, "user_id", "item_id")
    return lists.select("user_id", "part", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("items"))


@query
def loo_test(spark, folder):
    rows = numbering.reindex(purchases(spark, folder))[0]
    return split.leave_one_out(rows)[1]


@query
def loo_train(spark, folder):
    return split.leave_one_out(_numbered_events(spark, folder))[0]


@query
def leakage_check(spark, folder):
    train, test = split.leave_one_out(_numbered_events(spark, folder))
    return split.leakage(train, test)


@query
def prepare_summary(spark, folder):
    """Sizes after the whole preparation with a threshold and a user sample."""
    return summary_of(prepare(purchases(spark, folder), 25.0, 10, 10, 0.5))


# Weights, factors and loss


@query
def item_weights(spark, folder):
    data = prepared_purchases(spark, folder)
    return weights.item_weights(data.train, data.num_items).withColumn("c", F.round("c", 9))


@query
def init_factors(spark, folder):
    data = prepared_purchases(spark, folder)
    users = factors.init_factors(spark, data.num_users, 3, "user")
    items = factors.init_factors(spark, data.num_items, 3, "item")
    return _flat(users, "user", 3, 9).unionAll(_flat(items, "item", 3, 9))


@query
def gram_weighted(spark, folder):
    data = prepared_purchases(spark, folder)
    weight = weights.item_weights(data.train, data.num_items).select(F.col("item_id").alias("id"), "c")
    items = _start(spark, data)[1].join(weight, "id")
    return factors.gram(items, RANK, "c").withColumn("value", F.round("value", 9))


@query
def gram_plain(spark, folder):
    data = prepared_purchases(spark, folder)
    return factors.gram(_start(spark, data)[0], RANK).withColumn("value", F.round("value", 9))


def _one_half_step(spark, folder, by, of):
    """Update one side from the start factors with the popularity defaults."""
    data = prepared_purchases(spark, folder)
    user_start, item_start = _start(spark, data)
    store = GenerationStore(spark)
    weight = weights.item_weights(data.train, data.num_items).select(F.col("item_id").alias("id"), "c")
    pairs = data.train.persist()
    count = blocks.block_count(pairs.count(), RANK, spark.sparkContext.defaultParallelism)
    by_user = blocks.build_layout(pairs, "user_id", "item_id", count)
    by_item = blocks.build_layout(pairs, "item_id", "user_id", count)
    users = store.write("users", halfstep.factor_table(user_start, blocks.routes(by_item), by_user.heavy))
    items = store.write("items", halfstep.factor_table(item_start, blocks.routes(by_user), by_item.heavy, weight))
    goal = halfstep.Objective(RANK, 0.01, 1.0, 1.0)
    if by == "user":
        gram = factors.summarise(items, RANK, "weight").gram
        updated, _ = halfstep.half_step(by_user, users, items, gram, goal, False, store, "users")
    else:
        gram = factors.summarise(users, RANK).gram
        updated, _ = halfstep.half_step(by_item, items, users, gram, goal, True, store, "items")
    for frame in (pairs, by_user, by_item):
        frame.unpersist()
    return _flat(updated, by)


@query
def user_half_step(spark, folder):
    return _one_half_step(spark, folder, "user", "item")


@query
def item_half_step(spark, folder):
    return _one_half_step(spark, folder, "item", "user")


def _popular(spark, folder, rank=RANK, iterations=ITERATIONS, **options):
    data = prepared_purchases(spark, folder)
    return training.eals_train(
        data.train, data.num_users, data.num_items, K=rank, num_iter=iterations, start=_start(spark, data, rank), **options
    )


def _uniform(spark, folder, rank=RANK, iterations=ITERATIONS, **options):
    data = prepared_purchases(spark, folder)
    return training.eals_train_uniform(
        data.train, data.num_users, data.num_items, num_factors=rank, num_iter=iterations,
        start=_start(spark, data, rank), **options,
    )


@query
def eals_train(spark, folder):
    return _both(_popular(spark, folder))


@query
def eals_train_uniform(spark, folder):
    return _both(_uniform(spark, folder))


def _number(spark, name, value, digits):
    return spark.createDataFrame([(round(value, digits),)], f"{name} double")


@query
def loss_eq7(spark, folder):
    data = prepared_purchases(spark, folder)
    users, items = _start(spark, data)
    weight = weights.item_weights(data.train, data.num_items)
    return _number(spark, "loss", loss.weighted_loss(users, items, data.train, weight, RANK), 6)


@query
def loss_uniform(spark, folder):
    data = prepared_purchases(spark, folder)
    users, items = _start(spark, data)
    return _number(spark, "loss", loss.uniform_loss(users, items, data.train, RANK), 6)


# Ranking and evaluation


@query
def score_pairs(spark, folder):
    data = prepared_purchases(spark, folder)
    return ranking.score_pairs(data.test, *_start(spark, data))


@query
def recommend_topk(spark, folder):
    data = prepared_purchases(spark, folder)
    return ranking.recommend(*_start(spark, data), data.train, RANK, 10)


@query
def test_item_rank(spark, folder):
    data = prepared_purchases(spark, folder)
    return ranking.held_out_ranks(*_start(spark, data), data.train, data.test, RANK)


def _rounded(metrics):
    return metrics.select(*[F.round(name, 9).alias(name) for name in metrics.columns])


@query
def rank_eval_10(spark, folder):
    data = prepared_purchases(spark, folder)
    return _rounded(ranking.evaluate(*_start(spark, data), data.train, data.test, RANK))


@query
def rank_eval_multi(spark, folder):
    data = prepared_purchases(spark, folder)
    return _rounded(ranking.evaluate(*_start(spark, data), data.train, data.test, RANK, (5, 10, 20)))


# Experiments


def _round_columns(table, digits, *names):
    return table.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in table.columns])


@query
def convergence(spark, folder):
    data = prepared_purchases(spark, folder)
    table = experiments.convergence(data, RANK, ITERATIONS, start=_start(spark, data))
    return _round_columns(_round_columns(table, 4, "loss"), 9, *[c for c in table.columns if "_" in c])


@query
def k_sweep(spark, folder):
    data = prepared_purchases(spark, folder)
    table = experiments.k_sweep(
        data, (2, 4), 1, timed=False, options=lambda rank: {"start": _start(spark, data, rank)}
    )
    return _round_columns(table, 4, "final_loss")


@query
def size_sweep(spark, folder):
    data = prepared_purchases(spark, folder)
    table = experiments.size_sweep(
        data, (0.25, 1.0), RANK, 1, timed=False,
        options=lambda users, items: {"start": start_factors(spark, users, items, RANK)},
    )
    return _round_columns(table, 4, "final_loss")


def _sweep(spark, sources):
    table = experiments.dataset_sweep(
        sources, RANK, 1, timed=False,
        options=lambda users, items: {"start": start_factors(spark, users, items, RANK)},
    )
    names = [c for c in table.columns if c.startswith(("hr_", "ndcg_"))]
    return _round_columns(_round_columns(table, 4, "final_loss"), 9, *names)


@query
def dataset_sweep(spark, folder):
    return _sweep(spark, [("purchases", purchases(spark, folder), 1.0), ("events", events(spark, folder), 1.0)])


@query
def resplit_size_sweep(spark, folder):
    rows = purchases(spark, folder)
    return _sweep(spark, [("purchases", rows, fraction) for fraction in (0.25, 0.5)])


def _two_trainers(spark, folder):
    """One objective in two independent forms: the kernels with uniform weights, joins with popularity weights of exponent 0."""

    def relational_trainer(data):
        return relational.eals_train_relational(
            data.train, data.num_users, data.num_items, RANK, ITERATIONS,
            w_obs=1.0, c0=float(data.num_items), alpha=0.0, start=_start(spark, data),
        )

    return {"uniform": lambda _: _uniform(spark, folder, damped=False), "popularity": relational_trainer}


@query
def loss_parity(spark, folder):
    data = prepared_purchases(spark, folder)
    first, second = (run(data).loss_history() for run in _two_trainers(spark, folder).values())
    return _round_columns(experiments.loss_parity(first, second), 4, "loss_a", "loss_b")


@query
def trainer_comparison(spark, folder):
    data = prepared_purchases(spark, folder)
    table = experiments.compare_trainers(data, _two_trainers(spark, folder), ITERATIONS, timed=False)
    return _round_columns(_round_columns(table, 4, "final_loss"), 9, "hr_10")


@query
def baseline_als(spark, folder):
    """Ids that the model knows; the side it solves last fulfils its normal equations."""
    data = prepared_purchases(spark, folder)
    model = baseline.fit_baseline(data.train, 8, 5)
    solved = baseline.solves_normal_equations(model, data.train)
    users = model.userFactors.select(F.col("id").cast("long").alias("id"), "features").join(solved, "id")
    items = model.itemFactors.select(F.col("id").cast("long").alias("id"), "features", F.lit(None).cast("boolean").alias("solved"))
    user_side, item_side = (
        known.select(F.lit(side).alias("side"), "id", F.size("features").alias("length"), "solved")
        for known, side in ((users, "user"), (items, "item"))
    )
    return user_side.unionAll(item_side)


@query
def implicit_als(spark, folder):
    """Implicit ALS on the block layout: the side solved last fulfils its equations to rounding, be it items or users."""
    data = prepared_purchases(spark, folder)
    turned = data.train.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"))
    laid = training.lay_out(data.train, 8)
    runs = (
        ("item", data.train, data.num_users, data.num_items, laid),
        ("user", turned, data.num_items, data.num_users, laid.turned()),
    )
    sides = []
    for side, train, users, items, layouts in runs:
        model = training.als_train(train, users, items, 8, 3, layouts=layouts)
        solved = baseline.solved_rows(model.item_factors, model.user_factors, train, "item_id", "user_id", 8, tolerance=1e-8)
        known = model.item_factors.join(solved, "id")
        sides.append(known.select(F.lit(side).alias("side"), "id", F.size("features").alias("length"), "solved"))
    laid.unpersist()
    return sides[0].unionAll(sides[1])


@query
def baseline_factors(spark, folder):
    """Every id has a vector of full length, zeros where the model has none."""
    data = prepared_purchases(spark, folder)
    model = baseline.fit_baseline(data.train, 8, 5)
    users, items = baseline.baseline_factors(model, data.num_users, data.num_items)
    sizes = [
        side.select(F.lit(name).alias("side"), "id", F.size("features").alias("length"))
        for side, name in ((users, "user"), (items, "item"))
    ]
    return sizes[0].unionAll(sizes[1])


@query
def baseline_comparison(spark, folder):
    """Both methods, and whether their metrics lie and grow as they must; a test looks at the values."""
    table = experiments.baseline_comparison(prepared_purchases(spark, folder), 8, 5)
    growing = (F.col("hr_5") <= F.col("hr_10")) & (F.col("hr_10") <= F.col("hr_20"))
    inside = (F.col("hr_5") >= 0) & (F.col("hr_20") <= 1) & (F.col("ndcg_10") <= F.col("hr_10")) & (F.col("ndcg_10") >= 0)
    return table.select("method", growing.alias("growing"), inside.alias("inside"))
