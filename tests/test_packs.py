"""Rows packed by group are moved as few large rows and read back whole."""

import numpy as np
import pytest

from affinis.operators import ranking
from affinis.operators.packs import packed, unpacked


def _read(frame, rank):
    found = {}
    for pack in frame.collect():
        ids, values = (np.frombuffer(pack[name], dtype=kind) for name, kind in (("id", np.int64), ("features", np.float64)))
        found.setdefault(pack["to"], []).extend(zip(ids.tolist(), map(tuple, values.reshape(-1, rank).tolist()), strict=True))
    return {group: sorted(rows) for group, rows in found.items()}


@pytest.mark.parametrize("pack_bytes", [1, 200, 1 << 20])
def test_packs_hold_every_copy_once(spark, pack_bytes):
    groups = [[(n * step) % 7 for step in range(1, 1 + n % 4)] for n in range(50)]
    rows = [(sorted(set(to)), n, [float(n), -float(n)]) for n, to in enumerate(groups)]
    frame = spark.createDataFrame(rows, "to array<int>, id long, features array<double>").repartition(3)
    expected = {}
    for to, id_, features in rows:
        for group in to:
            expected.setdefault(group, []).append((id_, tuple(features)))
    assert _read(packed(frame, {"features": 2}, pack_bytes), 2) == expected


def test_packs_by_one_group_and_without_rows(spark):
    frame = spark.createDataFrame([(n % 3, n, [n / 2]) for n in range(20)], "to int, id long, features array<double>").coalesce(1)
    packs = packed(frame, {"features": 1})
    assert packs.count() == 3
    assert _read(packs, 1) == {to: [(n, (n / 2,)) for n in range(to, 20, 3)] for to in range(3)}
    assert packed(frame.filter("id < 0"), {"features": 1}).count() == 0
    column = packs.toArrow()["id"]
    assert sorted(unpacked(column).tolist()) == list(range(20))
    assert len(unpacked(column.slice(0, 0))) == 0


def test_ranking_moves_pairs_in_packs(spark):
    """A tile gets as many pair rows as tasks had pairs for it, not one for each pair."""
    items = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(30)], "id long, features array<double>")
    seen = spark.createDataFrame([(u, i) for u in range(40) for i in range(25)], "user_id long, item_id long").coalesce(1)
    tiles = ranking._Tiles(ranking.length_chunks(items, 2), seen, 40, 2, ranking.CHUNK_BYTES)
    users = spark.createDataFrame([(u, 29, [1.0, 0.0], 1.0, [0]) for u in range(40)], "user_id long, item_id long, features array<double>, score double, wanted array<int>")
    rows = tiles.packs(users.coalesce(1), ranking.F.lit(True)).toArrow().to_pylist()
    assert sum(len(row["a"]) // 8 for row in rows if row["role"] == 2) == 1000
    assert len([row for row in rows if row["role"] == 2]) == tiles._user_chunks
