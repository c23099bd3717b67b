"""Whitening of embeddings by the leading eigenvectors of their covariance.

Vectors become whole numbers, floor(256 c) for each entry c, and the covariance
is taken over the distinct ones. Its sums are exact: tasks multiply blocks of
vectors short enough for doubles to hold every partial sum without rounding,
Spark adds the results as decimals, and the driver centres them in whole
numbers of any length before it divides. Only such sums, a number per pair of
dimensions, reach the driver.

The eigenvectors come from contour integration (FEAST). A random block of
vectors is projected onto the eigenvalues of an interval by a quadrature, along
a circle around the interval, of solutions of the covariance shifted by complex
numbers; Rayleigh-Ritz on the projected block extracts eigenpairs, and the next
round starts from these. The interval is cut in a gap of the spectrum. How many
eigenvalues lie above a cut is known from its inertia, the negative pivots of
the shifted tridiagonal form (Sylvester); rounds end when as many pairs have
converged, so none is missed.

Defined cases: rows are left out whose vector is null, holds null, NaN or
infinite entries or entries of 2**39 and more, or has another length than most
vectors (of equally common lengths the greater counts). Repeated vectors count
once in the fit and each get their rows. Components with eigenvalue zero cannot
be scaled to one and are left out, so equal vectors, a single one or none give
no rows. Of equal eigenvalues any orthogonal eigenvectors are taken, the same
for all rows. ``deviation`` is null where it does not fit in a long. Null ids
are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from affinis.functions.arrow import matrix
from affinis.llm.frames import without_clashes
from affinis.runtime import cut_lineage

SCALE, COMPONENTS = 256, 4
#: Entries of this magnitude after scaling are refused: their sums would pass 38 digits.
MOST = 1 << 47
#: Whole numbers below this have exact sums of ROWS products in doubles.
SMALL, ROWS = 1 << 16, 1 << 20
NODES, ROUNDS = 16, 200
#: Eigenvalues below this share of the largest, and gaps below it, are rounding.
ROUNDING = 1e-12
MADE = ("component", "n", "deviation", "whitened", "explained", "identity_error")


# ---- eigenvectors of a symmetric matrix -------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of a tridiagonal matrix with the eigenvalues of ``a``, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0.0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k:]
        rest -= 2.0 * np.outer(v, v @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2.0 * np.outer(rest @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def counts_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each shift: positive pivots of the shifted tridiagonal matrix."""
    tiny = np.finfo(float).tiny
    above, pivot = np.zeros(len(shifts), dtype=np.int64), np.ones(len(shifts))
    squares = np.concatenate([[0.0], off * off])
    for value, square in zip(diagonal, squares, strict=True):
        pivot = value - shifts - square / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0.0
    return above


def spectrum(diagonal: np.ndarray, off: np.ndarray, steps: int = 48) -> np.ndarray:
    """All eigenvalues, falling, to about the rounding of the largest, by bisection on the counts."""
    reach = np.abs(diagonal) + np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    size, bound = len(diagonal), float(reach.max()) * (1 + 1e-9) + np.finfo(float).tiny
    low, high = np.full(size, -bound), np.full(size, bound)
    rank = np.arange(1, size + 1)
    for _ in range(steps):
        middle = (low + high) / 2
        enough = counts_above(diagonal, off, middle) >= rank
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return (low + high) / 2


def contour_projection(a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """``block`` projected onto the eigenvectors of ``a`` with eigenvalues between low and high, nearly."""
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    projected, unit = np.zeros_like(block), np.eye(len(a))
    for angle, weight in zip(np.pi / 2 * (1 + points), weights, strict=True):
        # The lower half of the circle gives the complex conjugate.
        arc = radius * np.exp(1j * angle)
        projected += weight / 2 * (arc * np.linalg.solve((middle + arc) * unit - a, block.astype(complex))).real
    return projected


def leading_eigenpairs(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``wanted`` largest positive eigenvalues, falling."""
    size = len(a)
    scale = float(np.abs(a).max()) if size else 0.0
    if not scale:
        return np.zeros(0), np.zeros((size, 0))
    a = a / scale
    form = tridiagonal(a)
    values = spectrum(*form)
    wanted = min(wanted, int((values > ROUNDING * values[0]).sum()))
    # The interval ends in the widest gap at or soon after the last wanted eigenvalue, if that is wide
    # enough for a contour to pass through, and else below all eigenvalues.
    after = np.append(values[1:], -values[0])
    gaps = (values - after)[wanted - 1 : 3 * wanted + 8]
    inside = wanted + int(np.argmax(gaps))
    if gaps.max() > 1e-3 * (values[0] - after[inside - 1]):
        found = _from_interval(a, form, values[0], (values[inside - 1] + after[inside - 1]) / 2, wanted)
        if found is not None:
            return found[0] * scale, found[1]
    found = _from_interval(a, form, values[0], min(values[-1], 0.0) - 1e-3 * values[0], wanted)
    if found is None:
        raise ArithmeticError("the counted eigenvalues were not all found")
    return found[0] * scale, found[1]


def _from_interval(a: np.ndarray, form: tuple[np.ndarray, np.ndarray], top: float, low: float, wanted: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The largest ``wanted`` eigenpairs above ``low``, or None if not all that are counted there converge."""
    high = top + max((top - low) * 0.05, 1e-3 * top)
    count = int(counts_above(*form, np.array([low]))[0])
    block = np.random.default_rng(1).standard_normal((len(a), min(len(a), count + max(8, count))))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(contour_projection(a, block, low, high))[0]
        ritz, small = np.linalg.eigh(basis.T @ a @ basis)
        ritz, block = ritz[::-1], basis @ small[:, ::-1]
        found = int((ritz > low).sum())
        errors = np.linalg.norm(a @ block[:, :wanted] - block[:, :wanted] * ritz[:wanted], axis=0)
        if found == count and errors.max() <= 8 * np.finfo(float).eps * len(a) ** 0.5 * top:
            return ritz[:wanted], block[:, :wanted]
    return None


# ---- sums of a table --------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``x``, its vector in whole numbers, in place of ``column``; rows without a proper one are left out."""
    entry = F.col(column)
    limit = float(MOST) / SCALE
    proper = entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < limit))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.filter(F.coalesce(proper, F.lit(False))).withColumn("x", x).drop(column)
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("x") == (common["width"] if common else 0))


def _limbs(x: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(values, factor) with x the sum of values times factor, each exact in products."""
    parts, factor = [], 1
    while np.abs(x).max(initial=0) >= SMALL:
        parts.append(((x & (SMALL - 1)).astype(float), factor))
        x, factor = x >> 16, factor * SMALL
    return [*parts, (x.astype(float), factor)]


@dataclass(frozen=True)
class Moments:
    """Exact sums over the fit list: how many vectors, per dimension, and per pair of dimensions."""

    count: int
    sums: np.ndarray
    products: np.ndarray

    def covariance(self) -> tuple[np.ndarray, float]:
        """(covariance, its trace), centred in whole numbers and rounded once."""
        centred = self.count * self.products - np.outer(self.sums, self.sums)
        square = self.count * self.count
        return (centred / square).astype(float), sum(np.diag(centred).tolist()) / square


def moments(fit: DataFrame, width: int) -> Moments:
    """The sums over the vectors ``x`` of ``fit``; a task sends one number per pair of dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for batch in batches:
            whole = matrix(batch.column(0), width)
            for first in range(0, len(whole), ROWS):
                x = whole[first : first + ROWS]
                count += len(x)
                parts = _limbs(x)
                for left, by in parts:
                    sums += by * left.sum(axis=0).astype(np.int64).astype(object)
                    for right, times in parts:
                        products += by * times * (left.T @ right).astype(np.int64).astype(object)
        if count:
            row, column = np.triu_indices(width)
            places = np.concatenate([[-1], np.full(width, -1), row])
            others = np.concatenate([[-1], np.arange(width), column])
            numbers = [Decimal(number) for number in (count, *sums.tolist(), *products[row, column].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(others, pa.int32()), pa.array(numbers, pa.decimal128(38, 0))], names=["i", "j", "number"])

    parts = fit.select("x").mapInArrow(add, "i int, j int, number decimal(38,0)")
    count, sums, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
    for i, j, number in parts.groupBy("i", "j").agg(F.sum("number")).collect():
        if i >= 0:
            products[i, j] = products[j, i] = int(number)
        elif j >= 0:
            sums[j] = int(number)
        else:
            count = int(number)
    return Moments(count, sums, products)


@dataclass(frozen=True)
class Whitening:
    """Components as columns, scaled to variance one over the fit list."""

    count: int
    sums: np.ndarray
    mean: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Squared lengths of n x - S."""
        reach = (self.count * np.abs(x.astype(float)) + np.abs(self.sums.astype(float))).max(initial=0.0)
        if reach * reach * max(1, x.shape[1]) < 2.0**62:
            apart = self.count * x - self.sums.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.count * x.astype(object) - self.sums
        return [total if total < 1 << 63 else None for total in (apart * apart).sum(axis=1).tolist()]


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Learned from the distinct vectors ``x`` of ``fit``."""
    total = moments(fit, width) if width else Moments(0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object))
    if not total.count:
        return Whitening(0, total.sums, np.zeros(width), np.zeros((width, 0)), np.zeros(0))
    covariance, trace = total.covariance()
    values, vectors = leading_eigenpairs(covariance, components)
    mean = (total.sums / total.count).astype(float)
    return Whitening(total.count, total.sums, mean, vectors / np.sqrt(values), values / trace if trace else values)


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    names = [f"w{k}" for k in range(len(model.explained))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in model.apply(matrix(batch.column(0), width)).T], names=names)

    whitened = fit.select("x").mapInArrow(project, ", ".join(f"{name} double" for name in names))
    means = whitened.agg(*(F.avg(name) for name in names)).first()
    apart = {name: F.col(name) - F.lit(mean) for name, mean in zip(names, means, strict=True)}
    pairs = [(a, b) for at, a in enumerate(names) for b in names[: at + 1]]
    sums = whitened.agg(*(F.sum(apart[a] * apart[b]) for a, b in pairs)).first()
    return max(abs(value / model.count - (a == b)) for (a, b), value in zip(pairs, sums, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors`` (embedding, other columns) with a row per vector and component and the columns of ``MADE`` in place of embedding."""
    rows = whole_numbers(without_clashes(vectors, ("embedding",), (*MADE, "x")))
    kept = [name for name in rows.columns if name != "x"]
    fit = cut_lineage(rows.select("x").distinct())
    first = fit.first()
    width = len(first["x"]) if first else 0
    model = fit_whitening(fit, width, components)
    found = len(model.explained)
    error = identity_error(fit, width, model) if found else 0.0

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not found:
                continue
            x = matrix(batch.column(len(kept)), width)
            at = pa.array(np.repeat(np.arange(len(x)), found))
            columns = [batch.column(k).take(at) for k in range(len(kept))]
            columns += [
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.count, dtype=np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(at),
                pa.array(model.apply(x).reshape(-1)),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *MADE])

    kinds = [IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]
    fields = [*(rows.schema[name] for name in kept), *(StructField(name, kind) for name, kind in zip(MADE, kinds, strict=True))]
    return rows.select(*kept, "x").mapInArrow(make, StructType(fields))
