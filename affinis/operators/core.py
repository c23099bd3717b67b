"""The maximal core in which every user and item has enough rows.

Keys with too few rows are peeled off, which takes rows from the other side,
until nothing falls. The first pairs that a side loses are found by a scan; for
the next ones the pair table is laid out by that side's key, and a step reads
the folders of the keys that fell out in the step before. While many fall, degrees are updated by a
join; once few do, the driver names them to the scans and keeps the counts that
have changed, so that a step of a core that falls apart key by key costs what
its few pairs cost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.expressions import bucket
from affinis.operators.interactions import pair_counts
from affinis.operators.keyed import NAMED_KEYS, ROWS_PER_FOLDER, KeyedTable, folders_for
from affinis.operators.skew import ROWS_PER_SLICE, heavy_keys, skew_join
from affinis.runtime import GenerationStore

# Pairs of the keys of one step, and changed counts, that the driver holds at most.
FEW_PAIRS = 100_000


class Side:
    """Remaining row counts of one side, and the step in which a key fell out.

    ``rows`` and ``pairs`` keep the counts at the start, by which joins of the
    row and pair tables are sliced; ``n`` is what remains. ``fallen`` counts the
    keys that fell out in the step last written.
    """

    def __init__(
        self,
        pairs: DataFrame,
        key: str,
        minimum: int,
        store: GenerationStore,
        rows_per_slice: int,
        table_rows: int | None,
        rows_per_folder: int = ROWS_PER_FOLDER,
    ):
        self.key, self.minimum, self._store, self._rows_per_slice = key, minimum, store, rows_per_slice
        self._pairs, self._table_rows, self._rows_per_folder = pairs, table_rows, rows_per_folder
        degrees = pairs.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
        state = degrees.select(
            key, "n", F.col("n").alias("rows"), "pairs", F.when(F.col("n") < minimum, F.lit(0)).alias("dropped_in")
        )
        self.state, self.fallen = self._write(state, 0)
        self.heavy = self.heavy_by("pairs", table_rows)
        self._index: KeyedTable | None = None
        self._folders: int | None = None
        self._scans = 0

    def _write(self, state: DataFrame, step: int) -> tuple[DataFrame, int]:
        return self._store.write_counting(f"core-{self.key}", state, F.col("dropped_in") == step)

    def heavy_by(self, column: str, table_rows: int | None = None) -> DataFrame | None:
        return heavy_keys(self.state, self.key, column, self._rows_per_slice, table_rows)

    @property
    def folders(self) -> int:
        if self._folders is None:
            rows = self._table_rows if self._table_rows is not None else self._pairs.count()
            self._folders = folders_for(rows, self._rows_per_folder)
        return self._folders

    def folder(self) -> Column:
        """The folder of this side's key."""
        return bucket(self.folders, F.col(self.key))

    @property
    def index(self) -> KeyedTable:
        """The pairs by this side's key."""
        if self._index is None:
            self._index = KeyedTable(self._pairs, self.key, self.folders, self.heavy)
        return self._index

    @property
    def rows_read(self) -> int:
        return 0 if self._index is None else self._index.rows_read

    def dropped(self, step: int) -> DataFrame:
        return self.state.filter(F.col("dropped_in") == step).select(self.key)

    def survivors(self) -> DataFrame:
        """Keys of the core. A side without a minimum never drops keys, but may lose all their rows."""
        return self.state.filter(F.col("dropped_in").isNull() & (F.col("n") > 0)).select(self.key)

    def lost_pairs(self, step: int) -> DataFrame:
        """The pairs of the keys that fell out in ``step``."""
        dropped = self.dropped(step)
        self._scans += 1
        if self._scans > 1:
            near = self.index.near(dropped, self.fallen)
            if self.fallen <= NAMED_KEYS:
                return near
        else:
            near = self._pairs
        return skew_join(near, dropped, self.key, "left_semi", self.heavy, self.fallen)

    def named_pairs(self, keys: dict) -> DataFrame:
        """The pairs of a few keys, given with their folders."""
        self._scans += 1
        return self.index.named(keys) if self._scans > 1 else self._pairs.filter(F.col(self.key).isin(list(keys)))

    def subtract(self, losses: DataFrame, step: int) -> None:
        """Lower the counts by ``losses`` (key, lost) and mark who falls below the minimum."""
        left = F.col("n") - F.coalesce(F.col("lost"), F.lit(0))
        mark = F.coalesce(F.col("dropped_in"), F.when(left < self.minimum, F.lit(step)))
        updated = self.state.join(losses, self.key, "left").select(
            self.key, left.alias("n"), "rows", "pairs", mark.alias("dropped_in")
        )
        self.state, self.fallen = self._write(updated, step)

    def few(self, step: int) -> dict | None:
        """(folder, pairs) of the keys that fell out in ``step``, if the driver may hold them and their pairs."""
        if self.fallen > NAMED_KEYS:
            return None
        rows = self.state.filter(F.col("dropped_in") == step).select(self.key, self.folder(), "pairs").collect() if self.fallen else []
        return {row[0]: (row[1], row[2]) for row in rows} if sum(row[2] for row in rows) <= FEW_PAIRS else None


@dataclass
class _Count:
    """What remains of a key, in the steps of few keys."""

    n: int
    pairs: int
    folder: int
    dropped_in: int | None


class _FewKeys:
    """One side while few keys fall: counts that changed are held here, others lie in a table by key."""

    def __init__(self, side: Side, fallen: dict):
        self.side, self.fallen = side, fallen
        self.changed: dict[object, _Count] = {}
        self._degrees: KeyedTable | None = None
        self._scans = 0

    def _degrees_of(self, keys: dict) -> DataFrame:
        self._scans += 1
        state = self.side.state.select(self.side.key, "n", "pairs", "dropped_in")
        if self._scans == 1:
            return state.filter(F.col(self.side.key).isin(list(keys)))
        if self._degrees is None:
            self._degrees = KeyedTable(state, self.side.key, self.side.folders)
        return self._degrees.named(keys)

    def losses(self, other: _FewKeys) -> list:
        """(key of the other side, its folder, rows lost) of the pairs of the fallen keys."""
        pairs = self.side.named_pairs({key: folder for key, (folder, _) in self.fallen.items()})
        key = other.side.key
        return pairs.groupBy(key).agg(F.sum("n").alias("lost")).select(key, other.side.folder(), "lost").collect()

    def subtract(self, losses: list, step: int) -> None:
        """Afterwards ``fallen`` has the keys that fell out in ``step``."""
        self.fallen = {}
        new = {key: folder for key, folder, _ in losses if key not in self.changed}
        names = list(new)
        for at in range(0, len(names), NAMED_KEYS):
            some = {key: new[key] for key in names[at : at + NAMED_KEYS]}
            for key, n, pairs, dropped_in in self._degrees_of(some).select(self.side.key, "n", "pairs", "dropped_in").collect():
                self.changed[key] = _Count(n, pairs, new[key], dropped_in)
        for key, _, lost in losses:
            count = self.changed[key]
            count.n -= lost
            if count.dropped_in is None and count.n < self.side.minimum:
                count.dropped_in = step
                self.fallen[key] = (count.folder, count.pairs)

    def pairs(self) -> int:
        return sum(pairs for _, pairs in self.fallen.values())

    def write_back(self, step: int) -> None:
        side = self.side
        if self.changed:
            kinds = T.StructType([side.state.schema[side.key], T.StructField("left", T.LongType()), T.StructField("mark", T.IntegerType())])
            rows = [(key, count.n, count.dropped_in) for key, count in self.changed.items()]
            changed = side.state.sparkSession.createDataFrame(rows, kinds)
            updated = side.state.join(changed, side.key, "left").select(
                side.key, F.coalesce("left", "n").alias("n"), "rows", "pairs", F.coalesce("dropped_in", "mark").alias("dropped_in")
            )
            side.state, _ = side._write(updated, step)
        side.fallen = len(self.fallen)


def _peel_few(users: Side, items: Side, few: tuple[dict, dict], step: int) -> int:
    """Steps in which few keys fall; ends at the fixpoint or when a step gets large. Returns the last step."""
    both = _FewKeys(users, few[0]), _FewKeys(items, few[1])
    while any(side.fallen for side in both):
        losses = [source.losses(target) if source.fallen else [] for source, target in (both, both[::-1])]
        step += 1
        # What users lose comes from items, and the other way round.
        for target, lost in zip(both[::-1], losses, strict=True):
            target.subtract(lost, step)
        if any(len(side.fallen) > NAMED_KEYS or side.pairs() > FEW_PAIRS or len(side.changed) > FEW_PAIRS for side in both):
            break
    for side in both:
        side.write_back(step)
    return step


def peel(
    pairs: DataFrame,
    user: str,
    item: str,
    min_user: int,
    min_item: int,
    rows_per_slice: int,
    table_rows: int | None = None,
    rows_per_folder: int = ROWS_PER_FOLDER,
) -> tuple[Side, Side]:
    """Peel both sides to the fixpoint.

    Only degree tables change. A step reads the pairs of the keys that fell out
    in the step before and subtracts them from the other side, so a pair is
    subtracted at most once per side over the whole run and no step rewrites
    the pairs.
    """
    store = GenerationStore(pairs.sparkSession)
    users = Side(pairs, user, min_user, store, rows_per_slice, table_rows, rows_per_folder)
    items = Side(pairs, item, min_item, store, rows_per_slice, table_rows, rows_per_folder)
    step = 0
    while users.fallen or items.fallen:
        # The first step is the large one.
        few = (users.few(step), items.few(step)) if step else (None, None)
        if None not in few:
            step = _peel_few(users, items, few, step)
            continue
        losses = []
        for source, target in ((users, items), (items, users)):
            if source.fallen:
                losses.append((target, source.lost_pairs(step).groupBy(target.key).agg(F.sum("n").alias("lost"))))
        step += 1
        users.fallen = items.fallen = 0
        for target, lost in losses:
            target.subtract(lost, step)
    return users, items


def core_filter(
    rows: DataFrame,
    min_user: int = 5,
    min_item: int = 0,
    user: str = "user_raw",
    item: str = "item_raw",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows of users with at least ``min_user`` and items with at least ``min_item`` rows.

    Rows are counted, not distinct pairs. Dropping one side may push the other
    below its minimum; the result is the unique largest set in which both hold.
    A minimum of 0 turns that side off.
    """
    if min_user <= 0 and min_item <= 0:
        return rows
    pairs = pair_counts(rows, user, item).persist()
    users, items = peel(pairs, user, item, min_user, min_item, rows_per_slice)
    kept = skew_join(rows, users.survivors(), user, "left_semi", users.heavy_by("rows"))
    result = skew_join(kept, items.survivors(), item, "left_semi", items.heavy_by("rows"))
    pairs.unpersist()
    return result
