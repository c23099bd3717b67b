"""Interaction scans: every source ends as (user_raw, item_raw, rating, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("user_raw", "item_raw", "rating", "ts")

# Record fields of the review files, in file order (fixed values).
REVIEW_SCHEMA = "user_id string, business_id string, stars string, date string"
REVIEW_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _required(name: str) -> Column:
    value = F.col(name)
    missing = F.raise_error(F.lit(f"review record without {name}"))
    return F.when(value.isNull(), missing).otherwise(value)


def scan_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines reviews, one object per line.

    Blank lines are skipped and further fields ignored; malformed JSON, a
    missing field, a non-numeric rating or an unreadable date fails the job.
    """
    records = spark.read.schema(REVIEW_SCHEMA).json(path, mode="FAILFAST")
    return records.select(
        _required("user_id").alias("user_raw"),
        _required("business_id").alias("item_raw"),
        _required("stars").cast("double").alias("rating"),
        F.to_timestamp_ntz(_required("date"), F.lit(REVIEW_DATE_FORMAT)).alias("ts"),
    )


def scan_interactions(
    table: DataFrame, user: Column | str, item: Column | str, rating: Column | str, ts: Column | str
) -> DataFrame:
    """Any table as interactions; only the four mapped expressions are read.

    A row without a user or without an item is not an interaction and is left
    out, so that null never gets a number of its own.
    """

    def column(source: Column | str) -> Column:
        return F.col(source) if isinstance(source, str) else source

    return table.select(
        column(user).alias("user_raw"),
        column(item).alias("item_raw"),
        column(rating).cast("double").alias("rating"),
        column(ts).alias("ts"),
    ).filter("user_raw IS NOT NULL AND item_raw IS NOT NULL")


def scan_embedded_json(
    table: DataFrame, user: str, json_column: str, item_path: str, item_type: str, rating: str, ts: str
) -> DataFrame:
    """Interactions whose item sits in a JSON string column."""
    item = F.get_json_object(F.col(json_column), item_path).cast(item_type)
    return scan_interactions(table, user, item, rating, ts)
