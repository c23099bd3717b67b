"""Learned and sampled operators: held-out accuracy, brute force, and odd inputs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import components, weighted_jaccard, weighted_sets
from pyspark.sql import functions as F
from test_exact import ODD, TEXTS, clashing, documents

from affinis.llm import near_duplicates, toxicity
from affinis.llm.components import component_labels

LABELS = "doc_id long, toxic int"


def marked_documents(count=600):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for name in range(count):
        own = [draw.choice(vocabulary) for _ in range(draw.randrange(20, 120))]
        toxic = name % 4 == 0
        if toxic:
            for _ in range(3):
                own.insert(draw.randrange(len(own)), draw.choice(["vile", "rotten", "scummy"]))
        rows.append((name, " ".join(own)))
        labels.append((name, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("sent", [4_000_000, 3])
def test_toxicity_on_held_out_rows(spark, sent):
    rows, labels = marked_documents()
    documents_ = spark.createDataFrame(rows, TEXTS)
    model = toxicity.fit_toxicity(documents_.filter("doc_id < 450"), spark.createDataFrame(labels, LABELS), broadcast_weights=sent)
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(clashing(documents_), model).collect()}
    assert all(0 <= score <= 1 for score in found.values())
    held = [(found[name], toxic) for name, toxic in labels if name >= 450]
    assert np.mean([(score >= 0.5) == bool(toxic) for score, toxic in held]) > 0.95


def test_toxicity_does_not_depend_on_what_is_sent(spark):
    rows, labels = marked_documents(200)
    documents_, table = spark.createDataFrame([*rows, *ODD], TEXTS), spark.createDataFrame(labels, LABELS)
    scores = []
    for sent in (4_000_000, 5, 0):
        model = toxicity.fit_toxicity(documents_, table, broadcast_weights=sent)
        scores.append(sorted((str(r.doc_id), round(r.score, 5)) for r in toxicity.score_toxicity(documents_, model).collect()))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 207


def test_toxicity_without_evidence(spark):
    rows = spark.createDataFrame(ODD, TEXTS)
    none, nothing = spark.createDataFrame([], LABELS), spark.createDataFrame([], TEXTS)
    unlabelled = toxicity.fit_toxicity(rows, none)
    assert {r.score for r in toxicity.score_toxicity(rows, unlabelled).collect()} == {0.0}
    one_class = toxicity.fit_toxicity(rows, spark.createDataFrame([(902, 1), (901, 1), (None, 1), (905, None)], LABELS))
    assert {round(r.score, 3) for r in toxicity.score_toxicity(rows, one_class).collect()} == {round(2 / 3, 3)}
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, none)).count() == 0


def copies():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(5))
    rows = []
    for _ in range(20):
        base = [word() for _ in range(150)]
        for _ in range(8):
            own = list(base)
            for _ in range(draw.randrange(9)):
                own[draw.randrange(len(own))] = word()
            rows.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    rows += [" ".join([*(word() for _ in range(60)), passage]) for _ in range(25)]
    return [(100 + k, text) for k, text in enumerate(rows)] + [(300, rows[0]), (301, rows[0].upper() + "!"), (302, "one two"), (303, "One, two")]


@pytest.mark.parametrize("large", [200, 1])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(near_duplicates, "LARGE_BUCKET", large)
    rows = copies()
    texts = [text for _, text in rows]
    sets = weighted_sets(texts)
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if weighted_jaccard(sets[a], sets[b]) >= near_duplicates.SIMILARITY]
    expected = {rows[k][0]: rows[c][0] for k, c in enumerate(components(len(rows), links))}
    found = near_duplicates.near_duplicate_classes(clashing(spark.createDataFrame(rows, TEXTS))).collect()
    got = {r.doc_id: r.class_id for r in found}
    assert all(expected[name] == expected[label] for name, label in got.items())
    # Sampling may miss a pair; dividing buckets, as for large ones, asks for two common bands.
    met = [got[rows[a][0]] == got[rows[b][0]] for a, b in links]
    assert len(met) > 40 and np.mean(met) >= (0.97 if large > 1 else 0.93)
    sizes = {c: sum(v == c for v in got.values()) for c in got.values()}
    assert all(r.class_rows == sizes[r.class_id] and r.is_representative == (r.doc_id == r.class_id) for r in found)


@pytest.mark.parametrize("tile", [512, 4])
def test_one_shared_band_is_enough_in_large_buckets(spark, monkeypatch, tile):
    real = near_duplicates._sketches

    def sketches(*given):
        # All share the first band only, and three of four samples of every other one.
        own = F.xxhash64("id").bitwiseAND(F.lit(0xFFFF))
        return real(*given).withColumn("bands", F.array(F.lit(7).cast("long"), *[own] * (near_duplicates.BANDS - 1)))

    monkeypatch.setattr(near_duplicates, "_sketches", sketches)
    monkeypatch.setattr(near_duplicates, "LARGE_BUCKET", 1)
    monkeypatch.setattr(near_duplicates, "TILE", tile, raising=False)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in range(0, 200, 20)]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    found = near_duplicates.near_duplicate_classes(rows, rounds=0).collect()
    assert {(r.class_id, r.class_rows) for r in found} == {(0, 10)}


def test_links_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    counts, real = [], near_duplicates.component_labels

    def labels(links):
        counts.append(links.count())
        return real(links)

    monkeypatch.setattr(near_duplicates, "component_labels", labels)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in range(0, 300, 8)]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    found = near_duplicates.near_duplicate_classes(rows, rounds=0).collect()
    assert {(r.class_id, r.class_rows) for r in found} == {(0, len(texts))}
    # All pairs are similar; a bucket needs fewer links than it has texts, and texts are in one for each band.
    assert max(counts) < len(texts) * near_duplicates.BANDS < len(texts) * (len(texts) - 1) / 2


def test_deduplicate_keeps_one_of_each(spark):
    rows = spark.createDataFrame([*copies(), *ODD], TEXTS)
    kept = [r.doc_id for r in near_duplicates.deduplicate(clashing(rows)).collect()]
    assert kept.count(904) == 1 and 901 in kept and 902 in kept and 903 in kept and None in kept
    assert 300 not in kept and 301 not in kept and 302 in kept and 303 not in kept and 100 in kept
    assert all(name in kept for name in range(260, 285))
    assert near_duplicates.deduplicate(spark.createDataFrame([], TEXTS)).count() == 0
    assert near_duplicates.near_duplicate_classes(spark.createDataFrame([(1, None), (1, None), (None, "")], TEXTS)).count() == 3


def test_samples_agree_as_often_as_sets_are_similar():
    draw = np.random.default_rng(0)
    agreements, similarity = [], []
    for _ in range(60):
        keys = np.sort(draw.integers(0, 1 << 62, 400).astype(np.uint64))
        a, b = (draw.gamma(2.0, 1.0, 400).astype(np.float32) for _ in range(2))
        mixed = np.where(draw.random(400) < 0.7, a, b)
        codes = near_duplicates.samples(np.repeat([0, 1], 400), np.concatenate([keys, keys]), np.concatenate([a, mixed]), 2)
        agreements.append((codes[0] == codes[1]).mean())
        similarity.append(near_duplicates.weighted_jaccard(keys, a, keys, mixed))
    assert abs(np.mean(agreements) - np.mean(similarity)) < 0.03


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    found = {r.id: r["class"] for r in component_labels(spark.createDataFrame(links, "a int, b int")).collect()}
    expected = components(200, links)
    assert all(label == expected[name] for name, label in found.items())
    assert set(found) == {x for a, b in links if a != b for x in (a, b)}


def test_frequencies_count_every_text(spark):
    rows = documents(spark)
    found = near_duplicates.document_frequencies(rows)
    assert found.texts == rows.count()
    sets = weighted_sets([r.text or "" for r in rows.collect()])
    assert found.slots.sum() == sum(map(len, sets))
    assert found.idf(np.array([0, 1 << 63], dtype=np.uint64)).min() >= 1.0


def test_frequencies_are_exact_whatever_slots_are_shared(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SLOT_BITS", 14)
    monkeypatch.setattr(near_duplicates, "RANGE_PAIRS", 5_000, raising=False)
    monkeypatch.setattr(near_duplicates, "CHUNK_BYTES", 20_000, raising=False)
    texts = [text for _, text in copies()]
    expected = {text: sorted(one.values()) for text, one in zip(texts, weighted_sets(texts), strict=True)}
    rows = spark.createDataFrame([(str(k).encode(), text) for k, text in enumerate(texts)], "id binary, text string")
    frequencies = near_duplicates.document_frequencies(rows)
    assert len(frequencies.edges()) > 3
    found = near_duplicates._sketches(near_duplicates._chunks(rows), frequencies).join(rows, "id").collect()
    assert len(found) == len(texts)
    for r in found:
        weights = near_duplicates.weighted_sets(pa.array([r.text]), pa.array([bytes(r.counts)]), frequencies.texts)[2]
        assert np.allclose(np.sort(weights), expected[r.text], rtol=1e-5)


def test_odd_column_values_survive(spark):
    rows = spark.createDataFrame(ODD, TEXTS).withColumn("Doc_ID", F.lit(7))
    assert near_duplicates.near_duplicate_classes(rows).count() == len(ODD)
