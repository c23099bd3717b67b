"""Views and start values on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.interactions import row_counts
from affinis.operators.skew import heavy_keys, skew_join
from affinis.plans.prepare import Prepared, prepare
from affinis.sources.interactions import scan_embedded_json, scan_interactions


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Customers buying parts; the quantity serves as the rating."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    degrees = row_counts(lines, "l_orderkey")
    heavy = heavy_keys(degrees, "l_orderkey", table_rows=lines.count())
    joined = skew_join(lines, orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "inner", heavy)
    return scan_interactions(joined, "o_custkey", "l_partkey", "l_quantity", "o_orderdate")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Users acting on the item named in the event's JSON properties."""
    table = spark.read.parquet(f"{folder}/events.parquet")
    return scan_embedded_json(table, "user_id", "props", "$.k", "bigint", "value", "ts")


_prepared: dict[tuple, Prepared] = {}


def _state(spark: SparkSession, folder: str, *tables: str) -> tuple:
    """What tells one state of the files of some tables from another."""
    found = []
    for table in tables:
        file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        files = spark.read.parquet(f"{folder}/{table}.parquet").select(file.alias("file"))
        found.append(tuple(files.agg(F.count("file"), F.bit_xor("file"), F.sum(F.col("file").cast("decimal(38,0)"))).first()))
    return tuple(found)


def prepared_purchases(spark: SparkSession, folder: str) -> Prepared:
    """The (10, 10) core of all purchases; kept per session and state of the files, as many queries start from it."""
    key = (spark.sparkContext.applicationId, folder, _state(spark, folder, "lineitem", "orders"))
    if key not in _prepared:
        _prepared[key] = prepare(purchases(spark, folder))
    return _prepared[key]


def _start(identifier: Column, rank: int, factor: int, step: int, shift: int, modulus: int) -> Column:
    terms = [
        ((identifier * factor + (f * step + shift)) % modulus - modulus // 2).cast("double") / F.lit(modulus * 50.0)
        for f in range(rank)
    ]
    return F.array(*terms)


def start_factors(spark: SparkSession, num_users: int, num_items: int, rank: int) -> tuple[DataFrame, DataFrame]:
    """Start factors that any engine computes to the last bit: one exact division each."""
    users = spark.range(num_users).select("id", _start(F.col("id"), rank, 7919, 104729, 13, 997).alias("features"))
    items = spark.range(num_items).select("id", _start(F.col("id"), rank, 6007, 15013, 29, 991).alias("features"))
    return users, items
