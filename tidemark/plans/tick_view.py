"""Ticks made from the table of events, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "EVENTS"

#: The same ticks in DuckDB; `t` is what the tests of ties replace.
SQL = """SELECT event_id + 1 AS source_row, epoch_us({ts}) * 1000 AS timestamp_ns, greatest(CAST(floor(value * 4) AS BIGINT), 1) AS last_ticks,
 greatest(CAST(floor(value * 4) AS BIGINT), 1) - event_id % 3 AS bid_ticks, greatest(CAST(floor(value * 4) AS BIGINT), 1) + event_id % 2 AS ask_ticks, user_id % 10 + 1 AS volume_contracts FROM events"""


def ticks(spark: SparkSession, sf_dir: str, minutes: bool = False) -> DataFrame:
    """minutes: times cut to the minute, so that many ticks share one and source_row alone orders them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.date_trunc("minute", "ts") if minutes else F.col("ts")
    last = F.greatest(F.floor(F.col("value") * 4).cast("long"), F.lit(1).cast("long"))
    return events.select(
        (F.col("event_id") + 1).alias("source_row"),
        (F.unix_micros(ts.cast("timestamp")) * 1000).alias("timestamp_ns"),
        last.alias("last_ticks"),
        (last - F.col("event_id") % 3).alias("bid_ticks"),
        (last + F.col("event_id") % 2).alias("ask_ticks"),
        (F.col("user_id") % 10 + 1).cast("decimal(20,0)").alias("volume_contracts"),
    )


def sql(minutes: bool = False) -> str:
    return SQL.format(ts="date_trunc('minute', ts)" if minutes else "ts")
