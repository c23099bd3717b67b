"""Column selection that survives extra and clashing columns."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _position(names: list[str], wanted: str) -> int:
    """An exact name wins over one that differs in case only; the first of equals is taken."""
    if wanted in names:
        return names.index(wanted)
    lower = [name.lower() for name in names]
    if wanted.lower() not in lower:
        raise ValueError(f"column {wanted} is missing; there are {', '.join(names)}")
    return lower.index(wanted.lower())


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"c{at}" for at in range(len(df.columns))))


def pick(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, whatever other columns are called."""
    return _numbered(df).select(*(F.col(f"c{_position(df.columns, name)}").alias(name) for name in wanted))


def without_clashes(df: DataFrame, needed: tuple[str, ...], made: tuple[str, ...]) -> DataFrame:
    """The needed columns first, then all others except those that an operator's
    own columns replace or that repeat an earlier name."""
    names, taken = df.columns, {name.lower() for name in (*needed, *made)}
    columns = [F.col(f"c{_position(names, name)}").alias(name) for name in needed]
    for at, name in enumerate(names):
        if name.lower() not in taken:
            taken.add(name.lower())
            columns.append(F.col(f"c{at}").alias(name))
    return _numbered(df).select(*columns)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile are removed when it is written, not at some later garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
