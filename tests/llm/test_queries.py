"""The registered queries and the pipeline on whole small tables."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from compare import connect, from_spark, from_sql
from plain import contamination, weighted_jaccard, weighted_sets
from test_exact import base_spans

from __spark_entry__ import oracle_sql, queries
from affinis.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
COLUMNS = {
    "op1_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op6_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op9_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op11_html_extraction": {"page_id", "url", "text", "n_chars"},
}
OTHER_COLUMNS = {
    "op12_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_phrase_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query_gives_a_row_for_each_row(spark, name):
    found = queries()[name](spark, FOLDER)
    assert set(found.columns) >= COLUMNS.get(name, set())
    assert found.columns == OTHER_COLUMNS.get(name, found.columns)
    if name in COLUMNS or name == "op10_near_duplicates":
        key = "page_id" if "page_id" in found.columns else "doc_id"
        table = spark.read.parquet(f"{FOLDER}/{'pages' if key == 'page_id' else 'documents'}.parquet")
        assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())
    else:
        assert found.count() > 0


def test_pipeline_stages_take_effect(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
    rows = {name: {r.doc_id: r.text for r in after.collect()} for name, (_, after) in seen.items() if name != "packing"}

    texts = list(rows["near_duplicates"].values())
    sets = weighted_sets(list(rows["toxicity"].values()))
    kept = [one for name, one in zip(rows["toxicity"], sets) if name in rows["near_duplicates"]]
    assert len(texts) < len(sets)
    assert not any(weighted_jaccard(a, b) >= 0.8 for k, a in enumerate(kept) for b in kept[:k] if a and b)

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    hits = contamination(list(rows["near_duplicates"].items()), items, 10)
    assert set(rows["decontamination"]) == {name for name, value in hits.items() if not value[1]}

    assert set(rows["secrets"]) == set(rows["decontamination"])
    for name, text in rows["decontamination"].items():
        assert (rows["secrets"][name] == text) == (base_spans(text) == "")
        assert base_spans(rows["secrets"][name]) == ""
    assert {r.doc_id for r in seen["packing"][1].collect()} == set(rows["secrets"])
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.select("doc_id", "piece", "piece_tokens").collect())) == sorted(
        map(str, seen["packing"][1].select("doc_id", "piece", "piece_tokens").collect())
    )


def test_entry_without_the_subpackage(tmp_path):
    """The other queries stay registered when the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "catalog", "affinis"):
        source = ROOT / name
        files = [source] if source.is_file() else [p for p in source.rglob("*.py") if "llm" not in p.parts]
        for file in files:
            target = tmp_path / file.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(file.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = connect(FOLDER)
    names, rows = from_spark(queries()[name](spark, FOLDER))
    expected_names, expected = from_sql(connection, ORACLES[name])
    connection.close()
    assert names == expected_names and rows == expected
    assert set(oracle_sql()) <= set(queries())
