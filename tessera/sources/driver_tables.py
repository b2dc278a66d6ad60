"""Catalog views of the star-schema tables: orders as studies, (order, supplier) as series, line items as instances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items that a task counts and joins at most, whatever the size of the tables: what it holds does not grow with them.
PART_ROWS = 250_000
#: Suppliers up to which they are broadcast (some 100 bytes each in memory).
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str, width: int = 12):
    return F.lpad(F.col(column).cast("string"), width, "0")


def study_columns() -> list[Column]:
    """The columns of a study, of an order."""
    return [padded("o_orderkey").alias("study_uid"), F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"), F.col("o_orderpriority").alias("study_description"), padded("o_custkey").alias("patient_id")]


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(study_columns())


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    series = F.concat(padded("l_orderkey"), F.lit("."), padded("l_suppkey", 8))
    return items.select(series.alias("series_uid"), padded("l_orderkey").alias("study_uid"), F.col("l_linenumber").alias("instance_number"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their region."""
    own = read(spark, sf_dir, "supplier")
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = own.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    return F.broadcast(found) if own.count() <= BROADCAST_ROWS else found


def parts_of(lines: DataFrame) -> int:
    """Parts that line items are dealt into."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // PART_ROWS))


def with_orders(spark: SparkSession, sf_dir: str, *columns: Column, found: Callable[[DataFrame], DataFrame], items: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """What found makes of the order and supplier of all line items, order by order, with columns of their orders and their suppliers.

    One shuffle by order serves both found and the join, in as many parts as the line items need. items, orders: line items and orders instead of all.
    """
    lines = (read(spark, sf_dir, "lineitem") if items is None else items).select("l_orderkey", "l_suppkey")
    parts = parts_of(lines)
    orders = (read(spark, sf_dir, "orders") if orders is None else orders).select("o_orderkey", "o_orderpriority", *columns).repartition(parts, "o_orderkey")
    both = found(lines.repartition(parts, "l_orderkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.join(suppliers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))


def named(lines: DataFrame, *more: str | Column) -> DataFrame:
    """Rows of (l_orderkey, l_suppkey, r_name, o_orderpriority) as series; the plane is the supplier's region, the weight the order's priority."""
    uid = F.concat(padded("l_orderkey"), F.lit("."), padded("l_suppkey", 8))
    return lines.select(uid.alias("series_uid"), padded("l_orderkey").alias("study_uid"), F.col("l_suppkey").cast("int").alias("series_number"), F.col("r_name").alias("plane"), F.col("o_orderpriority").alias("weight"), F.lit(None).cast("string").alias("sequence_type"), *more)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct series."""
    return named(with_orders(spark, sf_dir, found=lambda lines: lines.distinct()))


def counted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with their number of instances and their study's date: counted and joined by number, named last."""
    counts = lambda lines: lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("instance_count"))
    return named(with_orders(spark, sf_dir, F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"), found=counts), "instance_count", "study_date")


def exported(spark: SparkSession, sf_dir: str, items: DataFrame | None = None, orders: DataFrame | None = None) -> dict[str, DataFrame]:
    """Studies, series, instances and blobs, which hold the instance's own uid, of an export by the number of their order.

    All are dealt by this number in the same parts while they are numbers, and named there. items, orders: line items and orders instead of all.
    """
    items = read(spark, sf_dir, "lineitem") if items is None else items
    orders = read(spark, sf_dir, "orders") if orders is None else orders
    parts = parts_of(items)
    series = named(with_orders(spark, sf_dir, found=lambda lines: lines.distinct(), items=items, orders=orders), F.col("l_orderkey").alias("number"))
    lines = items.select("l_orderkey", "l_suppkey", "l_linenumber").repartition(parts, "l_orderkey")
    uids = {"sop_uid": F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), "series_uid": F.concat(padded("l_orderkey"), F.lit("."), padded("l_suppkey", 8)), "study_uid": padded("l_orderkey")}
    instances = lines.select(F.col("l_orderkey").alias("number"), *[c.alias(name) for name, c in uids.items()], F.col("l_linenumber").alias("instance_number"))
    blobs = lines.select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("number"), uids["sop_uid"].alias("sop_uid"))
    return {
        "studies": orders.repartition(parts, "o_orderkey").select(F.col("o_orderkey").alias("number"), *study_columns()), "series": series.withColumn("series_description", F.col("plane")), "instances": instances,
        "blobs": blobs.withColumn("content", F.col("sop_uid").cast("binary")),
    }
