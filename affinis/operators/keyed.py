"""Tables laid out by key, of which the rows of some keys can be read without the rest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.expressions import bucket
from affinis.operators.skew import with_slice
from affinis.runtime import checkpoint_root

# Rows of a folder, unless a single key has more, and folders of a table.
ROWS_PER_FOLDER = 1 << 20
MOST_FOLDERS = 4096
# Keys that are named to the scan one by one; more are found by a join with their folders.
NAMED_KEYS = 1000
_FOLDER = "_folder"


def folders_for(rows: int, rows_per_folder: int = ROWS_PER_FOLDER) -> int:
    return min(MOST_FOLDERS, max(1, math.ceil(rows / rows_per_folder)))


class KeyedTable:
    """``table`` hashed by key into folders and sorted inside them.

    A scan of some keys is pruned to their folders, and for a few keys to the
    pages that can hold them. Rows of heavy keys are written by several tasks.
    ``rows_read`` adds up the rows of the folders that scans asked for.
    """

    def __init__(self, table: DataFrame, key: str, folders: int, heavy: DataFrame | None = None):
        self.key, self.folders = key, folders
        path = f"{checkpoint_root(table.sparkSession)}/keyed-{uuid.uuid4().hex}"
        placed = with_slice(table, heavy, key).withColumn(_FOLDER, self.folder(F.col(key)))
        dealt = placed.repartition(_FOLDER, "slice").sortWithinPartitions(_FOLDER, key).drop("slice")
        dealt.write.partitionBy(_FOLDER).option("parquet.page.row.count.limit", 1000).parquet(path)
        schema = placed.drop("slice").schema
        self._table = table.sparkSession.read.schema(schema).parquet(path)
        # One number per folder; the counts come from file footers.
        self._sizes = dict(self._table.groupBy(_FOLDER).count().collect())
        self.rows_read = 0

    def folder(self, key: Column) -> Column:
        return bucket(self.folders, key)

    def _in(self, folders: Iterable[int]) -> DataFrame:
        folders = sorted(set(folders))
        self.rows_read += sum(self._sizes.get(number, 0) for number in folders)
        if len(folders) == self.folders:
            return self._table.drop(_FOLDER)
        return self._table.filter(F.col(_FOLDER).isin(folders)).drop(_FOLDER)

    def named(self, keys: dict) -> DataFrame:
        """Rows of at most NAMED_KEYS keys, given with their folders."""
        return self._in(keys.values()).filter(F.col(self.key).isin(list(keys)))

    def near(self, keys: DataFrame, count: int) -> DataFrame:
        """Rows of the folders in which the ``count`` distinct keys lie, for a join with them."""
        if count <= NAMED_KEYS:
            rows = keys.select(self.key, self.folder(F.col(self.key)).alias(_FOLDER)).collect()
            return self.named({row[0]: row[1] for row in rows})
        found = keys.select(self.folder(F.col(self.key)).alias(_FOLDER)).distinct().collect()
        return self._in(row[0] for row in found)
