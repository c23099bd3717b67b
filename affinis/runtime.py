"""Durable storage for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own setting wins.

    Only a local-mode session without a setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so a
    missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError(
                    "set spark.checkpoint.dir to a folder every executor can reach"
                )
            configured = tempfile.mkdtemp(prefix="affinis-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the table.

    A table rather than ``DataFrame.checkpoint``: later steps read only the
    columns they use, counts come from file footers, and the optimizer sees the
    true size when it picks join strategies.
    """
    return GenerationStore(df.sparkSession).write("once", df)


def cut_lineage_counting(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows written."""
    return GenerationStore(df.sparkSession).write_counting("once", df, F.lit(True))


class GenerationStore:
    """Tables rewritten once per step of an iterative job.

    Two slots per name are written in turn. A new generation is derived from
    the previous one, which sits in the other slot, so storage stays at two
    generations however long the loop runs, and no executor loss can reach
    behind the last written table.
    """

    def __init__(self, spark: SparkSession, compression: str = "snappy"):
        self._spark = spark
        # Factor vectors hardly compress; a caller writing those can turn it off.
        self._options = {"compression": compression, "parquet.enable.dictionary": "false"}
        self._root = f"{checkpoint_root(spark)}/generations-{uuid.uuid4().hex}"
        self._turn: dict[str, int] = {}

    def write(self, name: str, df: DataFrame, schema: StructType | None = None) -> DataFrame:
        turn = self._turn.get(name, 0)
        self._turn[name] = turn + 1
        path = f"{self._root}/{name}-{turn % 2}"
        schema = schema or df.schema
        df.write.mode("overwrite").options(**self._options).parquet(path)
        return self._spark.read.schema(schema).parquet(path)

    def write_counting(self, name: str, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """Write, and count the rows that fulfil ``condition`` in the same pass."""
        watch = Observation()
        table = self.write(name, df.observe(watch, F.count_if(condition).alias("rows")))
        counted = watch.get.get("rows")
        # Without an observation the table itself is counted; a wrong 0 would end a loop early.
        return table, table.filter(condition).count() if counted is None else counted


class RunLog:
    """Named tables and numbers of the last finished steps of a run, in a folder of the caller's choice.

    Two slots are written in turn. A slot is marked open before its tables are
    replaced and closed, with its step and numbers, after the last of them, so
    that a driver that dies at any moment leaves at least the step before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _mark(self, slot: int, key: str, step: int, numbers: list[float], closed: bool) -> None:
        row = self._spark.createDataFrame([(key, step, numbers, closed)], "key string, step int, numbers array<double>, closed boolean")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/mark-{slot}")

    def save(self, key: str, step: int, tables: dict[str, DataFrame], numbers: list[float]) -> None:
        """``key`` says what the run computes; a folder serves one such computation."""
        slot = step % 2
        self._mark(slot, key, step, numbers, False)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self._folder}/{name}-{slot}")
        self._mark(slot, key, step, numbers, True)

    def latest(self, key: str, names: list[str]) -> tuple[int, dict[str, DataFrame], list[float]] | None:
        """(step, tables, numbers) of the last step that was saved whole, or None."""
        found = None
        for slot in (0, 1):
            try:
                row = self._spark.read.parquet(f"{self._folder}/mark-{slot}").first()
            except AnalysisException:
                # Nothing was saved in this slot yet, or its mark was being replaced.
                continue
            if row is None or not row["closed"]:
                continue
            if row["key"] != key:
                raise ValueError(f"{self._folder} holds another run: {row['key']}, not {key}")
            if found is None or row["step"] > found[0]:
                found = row["step"], slot, list(row["numbers"])
        if found is None:
            return None
        step, slot, numbers = found
        return step, {name: self._spark.read.parquet(f"{self._folder}/{name}-{slot}") for name in names}, numbers
