"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.runtime import cut_lineage, cut_lineage_counting


def component_labels(links: DataFrame) -> DataFrame:
    """(id, class) of every id in ``links`` (a, b); class is the smallest id reachable.

    Each round hooks every id to its smallest neighbour and contracts the links
    to what still connects different ids, so the rounds follow the logarithm of
    the largest component. Tables are written each round: plans do not grow.
    """
    edges = cut_lineage(links.filter("a != b").select("a", "b").distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("id"), F.col("a").alias("other"))
        )
        hooked = cut_lineage(both.groupBy("id").agg(F.min("other").alias("low")).select("id", F.least("id", "low").alias("class")))
        if labels is None:
            labels = hooked
        else:
            onward = hooked.select(F.col("id").alias("class"), F.col("class").alias("onward"))
            labels = cut_lineage(labels.join(onward, "class", "left").select("id", F.coalesce("onward", "class").alias("class")))
        left = hooked.select(F.col("id").alias("a"), F.col("class").alias("x"))
        right = hooked.select(F.col("id").alias("b"), F.col("class").alias("y"))
        contracted = (
            edges.join(left, "a").join(right, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        edges, count = cut_lineage_counting(contracted)
        if not count:
            return labels
