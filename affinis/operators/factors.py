"""Factor tables (id, features) and their Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.arrow import matrix
from affinis.functions.expressions import gaussian_vector


def init_factors(spark: SparkSession, count: int, rank: int, side: str, seed: int = 42, std: float = 0.01) -> DataFrame:
    """Normal(0, std) start factors for ids 0..count-1; ``side`` separates users from items."""
    ids = spark.range(count)
    return ids.select("id", gaussian_vector(F.col("id"), rank, seed, side, std).alias("features"))


def _gram_cells(factors: DataFrame, rank: int, weight: str | None, also: str | None) -> DataFrame:
    """(cell, value) sums over the rows.

    Cell a * rank + b holds X' diag(weight) X at (a, b); then follow the sum of
    squares of X and the sum of the column ``also``. Each task adds up its rows
    and sends rank^2 + 2 numbers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((rank, rank))
        squares = extra = 0.0
        for batch in batches:
            x = matrix(batch.column("features"), rank)
            scale = batch.column("scale").to_numpy(zero_copy_only=False)
            sums += (x * scale[:, None]).T @ x
            squares += float(np.einsum("nk,nk->", x, x))
            extra += float(batch.column("extra").to_numpy(zero_copy_only=False).sum())
        values = np.concatenate([sums.reshape(-1), [squares, extra]])
        cells = np.arange(len(values), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values)], names=["cell", "value"])

    inputs = factors.select(
        "features",
        (F.lit(1.0) if weight is None else F.col(weight)).alias("scale"),
        (F.lit(0.0) if also is None else F.col(also)).alias("extra"),
    )
    partials = inputs.mapInArrow(partial, "cell int, value double")
    return partials.groupBy("cell").agg(F.sum("value").alias("value"))


def gram(factors: DataFrame, rank: int, weight: str | None = None) -> DataFrame:
    """(a, b, value): the rank x rank matrix X' diag(weight) X."""
    cells = _gram_cells(factors, rank, weight, None).filter(F.col("cell") < rank * rank)
    return cells.select(
        F.floor(F.col("cell") / rank).cast("int").alias("a"), (F.col("cell") % rank).cast("int").alias("b"), "value"
    )


@dataclass(frozen=True)
class Summary:
    """What the driver holds of a factor table: rank^2 + 2 numbers."""

    gram: np.ndarray
    squares: float
    extra: float

    @classmethod
    def of(cls, values: np.ndarray, rank: int) -> Summary:
        return cls(values[:-2].reshape(rank, rank), float(values[-2]), float(values[-1]))


def summarise(factors: DataFrame, rank: int, weight: str | None = None, also: str | None = None) -> Summary:
    values = np.zeros(rank * rank + 2)
    for row in _gram_cells(factors, rank, weight, also).collect():
        values[row["cell"]] = row["value"]
    return Summary.of(values, rank)
