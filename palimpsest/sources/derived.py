"""Redo logs that Spark derives from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import link_previous


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: an event is a record, a user a page, four events a group; without prev_lsn."""
    return _as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _as_log(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def _as_log(e: DataFrame) -> DataFrame:
    return e.select(
        (F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("page_id"), ((F.col("event_id") % 16) * 8).cast("int").alias("offset"),
        F.col("event_type").cast("binary").alias("data"), F.floor(F.col("event_id") / 4 + 1).alias("batch_id"), F.floor(F.col("event_id") / 4 + 1).alias("mtr_id"),
        (F.col("event_id") % 4 == 3).alias("is_mtr_end"), F.when(F.col("event_id") % 3 == 0, "B").otherwise("A").alias("node"),
    )


def linked_events_log(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return link_previous(events_log(spark, sf_dir), compat)


def lineitem_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as batches of writes: an order is a batch, a supplier a page."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_suppkey").alias("page_id"), (F.col("l_linenumber") * 32).cast("int").alias("offset"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string")).cast("binary").alias("data"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    )
