"""Toxicity by two class-conditional Kneser-Ney bigram models.

Both models see words (``llm.text``). A class's bigram counts are discounted
and interpolated with its word counts, these are discounted and interpolated
with continuation counts (in how many contexts a word occurs) shared by both
classes. Counts are numbers of distinct texts, so repeats inside a text and
exact copies count once. A count n is discounted by 2.7 of its standard
deviations, 2.7 sqrt(n), in units of the smaller class: what could be chance is
judged by the shared counts alone, and both models drop equally rare words.

The log-likelihood ratio of a text is a sum over its distinct words and
bigrams, so it is stored as one weight per word and one per bigram that differs
from its backoff; all other bigrams add nothing. Two figures enter a logistic
calibration, fitted on labelled rows that the counts have not seen: the ratio
per bigram, and how far single words exceed a ratio of e, per bigram.

Defined cases: null is the empty text; a text without words gets the share of
toxic rows among the labelled ones; without labelled rows all scores are 0;
labels of one document that disagree count as toxic; null labels and null ids
are unlabelled; an input column named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from affinis.llm.frames import broadcast_if, fits, pick, without_clashes
from affinis.llm.text import Lookup, bounded, distinct, lists, pair_key, rows_of, signed, words
from affinis.runtime import cut_lineage

#: A count is discounted by so many of its standard deviations, and by LEAST_DISCOUNT at least.
DEVIATIONS, LEAST_DISCOUNT = 2.7, 0.75
#: Log ratio beyond which a word counts as telling by itself.
MARGIN = 1.0
#: Weights nearer to zero than this are left out of the model.
RESOLUTION = 0.01
#: Rows of the model that every task gets (16 bytes each); the others are joined by shuffle.
BROADCAST_WEIGHTS = 4_000_000
BROADCAST_LABELS = 1_000_000
#: The calibration is fitted on at most so many labelled rows, in the order of a hash.
CALIBRATION_ROWS = 20_000
START = np.uint64(0x5851F42D4C957F2D)


@dataclass
class ToxicityModel:
    """``weights``: key, weight, excess, seen. ``calibration``: bias and two slopes, or None."""

    weights: DataFrame
    calibration: tuple[float, float, float] | None
    prior: float
    broadcast_weights: int


def _keys(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Distinct bigrams of each row: (row, context, word, bigram key), and the number of rows."""
    hashes, bounds = words(column)
    left = np.concatenate([[START], hashes[:-1]]).astype(np.uint64)[: len(hashes)]
    left[bounds[:-1][np.diff(bounds) > 0]] = START
    row, key = rows_of(bounds), pair_key(left, hashes)
    first = distinct(row, key)
    return row[first], left[first], hashes[first], key[first], len(bounds) - 1


def _count_bigrams(batches):
    for batch in bounded(batches, 0):
        row, left, word, key, _ = _keys(batch.column(0))
        if not len(key):
            continue
        toxic = batch.column(1).to_numpy(zero_copy_only=False)[row] == 1
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        counts = [np.bincount(group, weights=part, minlength=len(first)).astype(np.int64) for part in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(left[first])), pa.array(signed(word[first])), pa.array(counts[0]), pa.array(counts[1])],
            names=["u", "w", "toxic", "clean"],
        )


def _freed(count: Column, scale: float) -> Column:
    """The part of a count that goes to the level below."""
    deviation = F.lit(DEVIATIONS) * F.sqrt(count * F.lit(scale))
    return F.least(count.cast("double"), F.greatest(F.lit(LEAST_DISCOUNT), deviation))


def _weights(training: DataFrame, scale: dict[str, float]) -> DataFrame:
    """One weight per word and per telling bigram of ``training`` (text, toxic).

    ``scale``: size of each class against the smaller one.
    """
    classes = tuple(scale)
    bigrams = (
        training.select("text", "toxic")
        .dropDuplicates(["text", "toxic"])
        .mapInArrow(_count_bigrams, "u long, w long, toxic long, clean long")
        .groupBy("u", "w")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    fields = [*(f"{kind}_{name}" for name in classes for kind in ("total", "freed", "count")), "contexts"]

    def row(kind: int, key: Column, other: Column, given: dict[str, Column]) -> Column:
        filled = [given.get(name, F.lit(0.0) if name.startswith("freed") else zero).alias(name) for name in fields]
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), other.alias("other"), *filled)

    counts_of = {f"count_{name}": F.col(name) for name in classes}
    as_context = {f"total_{name}": F.col(name) for name in classes}
    as_context |= {f"freed_{name}": _freed(F.col(name), scale[name]) for name in classes}
    telling = reduce(lambda a, b: a | b, (F.col(name) > _freed(F.col(name), scale[name]) + 1e-9 for name in classes))
    # A context or word that keeps nothing in either class backs off alike in both.
    rows = F.array(
        F.when(telling, row(1, F.col("u"), F.col("w"), counts_of)),
        row(0, F.col("u"), none, as_context),
        row(0, F.col("w"), none, counts_of | {"contexts": F.lit(1).cast("long")}),
    )
    counts = cut_lineage(
        bigrams.select(F.explode(rows).alias("r"))
        .filter(F.col("r").isNotNull())
        .select("r.*")
        .groupBy("kind", "key", "other")
        .agg(*(F.sum(name).alias(name) for name in fields))
    )
    vocabulary = counts.filter("kind = 0")
    totals = vocabulary.agg(
        F.count(F.lit(1)).alias("words"),
        F.sum("contexts").alias("contexts"),
        *(F.sum(f"count_{name}").cast("double").alias(f"count_{name}") for name in classes),
        *(F.sum(_freed(F.col(f"count_{name}"), scale[name])).alias(f"freed_{name}") for name in classes),
    ).first()
    if not totals["words"]:
        return training.sparkSession.createDataFrame([], "key long, weight double, excess double, seen long")

    tiny = 1e-12
    spare = {name: max((totals[f"freed_{name}"] or 0.0) / totals[f"count_{name}"], tiny) if totals[f"count_{name}"] else 1.0 for name in classes}
    shared = (F.col("contexts") + 1.0) / F.lit(float(totals["contexts"] + totals["words"]))

    def word_probability(name: str) -> Column:
        kept = (F.col(f"count_{name}") - _freed(F.col(f"count_{name}"), scale[name])) / F.lit(totals[f"count_{name}"] or 1.0)
        return kept + F.lit(spare[name]) * shared

    def backoff(name: str) -> Column:
        share = F.col(f"freed_{name}") / F.col(f"total_{name}")
        return F.greatest(F.when(F.col(f"total_{name}") > 0, share).otherwise(F.lit(1.0)), F.lit(tiny))

    tokens = vocabulary.select(
        "key",
        *(word_probability(name).alias(f"p_{name}") for name in classes),
        *(backoff(name).alias(f"b_{name}") for name in classes),
        *(F.greatest(F.col(f"total_{name}"), F.lit(1)).alias(f"total_{name}") for name in classes),
        (F.col("count_toxic") + F.col("count_clean")).alias("seen"),
    )
    # What a word that neither class keeps would get; it is alike for all of them, so it is taken out.
    unknown = F.lit(float(np.log(spare["toxic"]) - np.log(spare["clean"])))
    of_word = F.when(F.col("seen") > 0, F.log("p_toxic") - F.log("p_clean") - unknown).otherwise(F.lit(0.0))
    of_context = F.log("b_toxic") - F.log("b_clean")
    excess = F.greatest(of_word - F.lit(MARGIN), F.lit(0.0))
    word_weights = tokens.select("key", (of_word + of_context).alias("weight"), excess.alias("excess"), "seen").filter(
        (F.abs("weight") >= RESOLUTION) | (F.col("excess") > 0)
    )
    bigram_rows = counts.filter("kind = 1").select(
        F.col("key").alias("u"), F.col("other").alias("w"), *(F.col(f"count_{name}").alias(name) for name in classes)
    )
    context_side = tokens.select(F.col("key").alias("u"), *(f"{kind}_{name}" for name in classes for kind in ("b", "total")))
    word_side = tokens.select(F.col("key").alias("w"), "p_toxic", "p_clean")

    def gain(name: str) -> Column:
        kept = (F.col(name) - _freed(F.col(name), scale[name])) / F.col(f"total_{name}")
        return F.log1p(kept / (F.col(f"b_{name}") * F.col(f"p_{name}")))

    bigram_weights = (
        bigram_rows.join(context_side, "u")
        .join(word_side, "w")
        .select("u", "w", (gain("toxic") - gain("clean")).alias("weight"), (F.col("toxic") + F.col("clean")).alias("seen"))
        .filter(F.abs("weight") >= RESOLUTION)
        .mapInArrow(_bigram_keys, "key long, weight double, seen long")
        .select("key", "weight", F.lit(0.0).alias("excess"), "seen")
    )
    return cut_lineage(word_weights.unionByName(bigram_weights))


def _bigram_keys(batches):
    for batch in batches:
        left, right = (batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64) for at in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(pair_key(left, right))), batch.column(2), batch.column(3)], names=["key", "weight", "seen"]
        )


def _ratios(documents: DataFrame, weights: DataFrame, broadcast_weights: int) -> DataFrame:
    """``documents`` with ``ratio`` and ``excess`` (sums over distinct keys) and ``n_keys`` (distinct bigrams)."""
    model = weights.select("key", F.col("weight").cast("float"), F.col("excess").cast("float"))
    most_seen = weights.orderBy(F.desc("seen"), "key").limit(broadcast_weights).select(*model.columns[:1], *(F.col(x).cast("float") for x in model.columns[1:]))
    whole = fits(weights, broadcast_weights)
    table = (model if whole else most_seen).toArrow()
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    values = np.column_stack([table.column(name).to_numpy().astype(np.float32) for name in ("weight", "excess")])
    lookup = documents.sparkSession.sparkContext.broadcast(Lookup(keys, values))
    at, names = documents.columns.index("text"), documents.columns

    def add(batches):
        known_weights = lookup.value
        for batch in bounded(batches, at):
            row, left, word, bigram, count = _keys(batch.column(at))
            sums = np.zeros((2, count))
            rest_rows, rest_keys = [], []
            once = distinct(row, word)
            for where, asked in ((row[once], word[once]), (row, bigram)):
                value, met = known_weights.find(asked)
                for total, part in zip(sums, value.T, strict=True):
                    total += np.bincount(where, weights=part, minlength=count)
                rest_rows.append(where[~met])
                rest_keys.append(asked[~met])
            n_keys = np.bincount(row, minlength=count).astype(np.int64)
            columns = [*batch.columns, pa.array(sums[0]), pa.array(sums[1]), pa.array(n_keys)]
            if not whole:
                place, key = np.concatenate(rest_rows), np.concatenate(rest_keys)
                order = np.argsort(place, kind="stable")
                columns.append(lists(signed(key[order]), np.searchsorted(place[order], np.arange(count + 1)), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(field.name for field in added)])

    added = [StructField("ratio", DoubleType()), StructField("excess", DoubleType()), StructField("n_keys", LongType())]
    if not whole:
        added.append(StructField("rest", ArrayType(LongType())))
    known = documents.mapInArrow(add, StructType([*documents.schema.fields, *added]))
    if whole:
        return known
    # The rest of the model is met by shuffle: one row per text and key that was not sent to the tasks.
    known = cut_lineage(known.withColumn("row_no", F.monotonically_increasing_id()))
    others = model.join(most_seen.select("key"), "key", "left_anti")
    met = (
        known.select("row_no", F.explode("rest").alias("key"))
        .join(others, "key")
        .groupBy("row_no")
        .agg(F.sum("weight").alias("more_ratio"), F.sum("excess").alias("more_excess"))
    )
    more = [(F.col(name) + F.coalesce(f"more_{name}", F.lit(0.0))).alias(name) for name in ("ratio", "excess")]
    return known.join(met, "row_no", "left").select(*names, *more, "n_keys")


def _logistic(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Bias and slopes by Newton's method with a small ridge."""
    scale = features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), features / scale])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (toxic - p) - 1e-2 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale[0]), float(beta[2] / scale[1])


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    broadcast_weights: int = BROADCAST_WEIGHTS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> ToxicityModel:
    """Learn from ``documents`` (doc_id, text) that have a row in ``labels`` (doc_id, toxic).

    Three quarters of the documents give counts, the others the calibration;
    equal ids fall on one side.
    """
    marks = (
        pick(labels, "doc_id", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    labelled = pick(documents, "doc_id", "text").join(broadcast_if(marks, fits(marks, BROADCAST_LABELS)), "doc_id")
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(4))
    share = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic_rows, clean_rows = (share[0] or 0), share[1] - (share[0] or 0)
    prior = toxic_rows / (share[1] + 1)
    ratio = max(clean_rows, 1) / max(toxic_rows, 1)
    weights = _weights(labelled.filter(fold != 0), {"toxic": max(1 / ratio, 1.0), "clean": max(ratio, 1.0)})
    scored = _ratios(labelled.filter(fold == 0), weights, broadcast_weights)
    sample = (
        scored.filter("n_keys > 0")
        .select("ratio", "excess", "n_keys", "toxic", F.xxhash64(F.col("doc_id").cast("string"), F.lit("order")).alias("at"))
        .orderBy("at", "ratio", "n_keys", "toxic")
        .limit(calibration_rows)
        .toPandas()
    )
    toxic = sample["toxic"].to_numpy(dtype=float)
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(weights, None, prior, broadcast_weights)
    features = sample[["ratio", "excess"]].to_numpy(dtype=float) / sample[["n_keys"]].to_numpy(dtype=float)
    return ToxicityModel(weights, _logistic(features, toxic), prior, broadcast_weights)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``documents`` and ``score``, 0 to 1; higher is likelier toxic."""
    made = ("score", "ratio", "excess", "n_keys", "rest", "row_no", "more_ratio", "more_excess")
    rows = without_clashes(documents, ("text",), made)
    if model.calibration is None:
        return rows.withColumn("score", F.lit(float(model.prior)))
    bias, by_ratio, by_excess = (F.lit(x) for x in model.calibration)
    evidence = bias + by_ratio * F.col("ratio") / F.col("n_keys") + by_excess * F.col("excess") / F.col("n_keys")
    score = F.when(F.col("n_keys") > 0, 1.0 / (1.0 + F.exp(-evidence))).otherwise(F.lit(float(model.prior)))
    return _ratios(rows, model.weights, model.broadcast_weights).withColumn("score", score).drop("ratio", "excess", "n_keys")
