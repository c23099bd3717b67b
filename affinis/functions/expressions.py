"""JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_positive(rating: Column, threshold: float) -> Column:
    """Strictly above the threshold. Spark ranks NaN above every number, so it is excluded."""
    return (rating > F.lit(float(threshold))) & ~F.isnan(rating)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two equally long arrays, summed from the first element on."""
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, term: total + term)


def gain(rank: Column, k: int) -> Column:
    """Discounted gain of a single relevant item found at ``rank``."""
    inside = rank <= F.lit(k)
    discount = F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))
    return F.when(inside, discount).otherwise(F.lit(0.0))


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= F.lit(k), F.lit(1.0)).otherwise(F.lit(0.0))


def sampling_key(identifier: Column, seed: int) -> Column:
    """Fixed-width hexadecimal key that orders identifiers pseudo-randomly."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def bucket(count: int, *columns: Column) -> Column:
    """Stable bucket number in ``[0, count)``."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def gaussian_vector(identifier: Column, length: int, seed: int, label: str, std: float) -> Column:
    """Normal draws that depend on (seed, label, identifier, position) only.

    Each MD5 digest yields two 52-bit uniforms and, by Box-Muller, two normal
    values. The result is the same under any partitioning or retry.
    """
    scale = F.lit(float(2**52))
    digests = F.transform(
        F.sequence(F.lit(0), F.lit((length + 1) // 2 - 1)),
        lambda j: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(label), identifier.cast("string"), j.cast("string"))),
    )

    def uniform(digest: Column, start: int) -> Column:
        return F.conv(F.substring(digest, start, 13), 16, 10).cast("long").cast("double")

    def two_normals(digest: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log((uniform(digest, 1) + F.lit(1.0)) / scale))
        angle = F.lit(6.283185307179586) * (uniform(digest, 14) / scale)
        return F.array(F.lit(float(std)) * radius * F.cos(angle), F.lit(float(std)) * radius * F.sin(angle))

    return F.slice(F.flatten(F.transform(digests, two_normals)), 1, length)
