import json

import pytest

from affinis.operators.interactions import pair_counts
from affinis.sources.interactions import scan_reviews
from affinis.sources.sinks import write_csv, write_json, write_parquet

GOOD = {"user_id": "ü1", "business_id": "b1", "stars": 4.0, "date": "2016-05-28 01:02:03", "text": "ignored"}


def write_lines(folder, *lines):
    path = folder / "reviews.json"
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_reviews_are_typed_and_blank_lines_skipped(spark, tmp_path):
    path = write_lines(tmp_path, json.dumps(GOOD), "", "   ", json.dumps({**GOOD, "stars": "3.5"}))
    rows = scan_reviews(spark, path).orderBy("rating").collect()
    assert [(r["user_raw"], r["item_raw"], r["rating"], str(r["ts"])) for r in rows] == [
        ("ü1", "b1", 3.5, "2016-05-28 01:02:03"),
        ("ü1", "b1", 4.0, "2016-05-28 01:02:03"),
    ]


@pytest.mark.parametrize(
    "line",
    [
        json.dumps({k: v for k, v in GOOD.items() if k != "stars"}),
        json.dumps({**GOOD, "stars": "many"}),
        json.dumps({**GOOD, "date": "yesterday"}),
        '{"user_id": "u"',
    ],
    ids=["missing field", "bad number", "bad date", "broken json"],
)
def test_bad_records_fail(spark, tmp_path, line):
    path = write_lines(tmp_path, json.dumps(GOOD), line)
    with pytest.raises(Exception):
        scan_reviews(spark, path).collect()


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(Exception):
        scan_reviews(spark, str(tmp_path / "nowhere.json")).collect()


def test_only_used_columns_are_read(spark):
    from catalog.fixtures import purchases

    plan = pair_counts(purchases(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_sinks_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("25%", 10, None), ("100%", 40, 0.5)], "label string, n long, hr_10 double")
    write_csv(table, str(tmp_path / "csv"))
    back = spark.read.schema(table.schema).csv(str(tmp_path / "csv"), header=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    write_json(table, str(tmp_path / "json"))
    back = spark.read.schema(table.schema).json(str(tmp_path / "json"))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    assert any('"hr_10":null' in f.read_text() for f in (tmp_path / "json").glob("part-*"))
    write_parquet(table, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
