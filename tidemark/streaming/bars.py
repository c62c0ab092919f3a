"""Bars and flow over a stream of ticks: buckets of event time with a watermark, closed once it has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import checked, volume_sum
from ..functions.time import bucket, iso
from ..operators.bars import measures, shown, width_ns
from ..operators.flow import side


def _bucketed(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """The watermark needs a timestamp, which has microseconds: it is kept beside the nanoseconds, only to tell what is late."""
    start = bucket(F.col("timestamp_ns"), width_ns(width))
    timed = ticks.withColumn("bucket_ns", start).withColumn("bucket_time", F.timestamp_micros(F.call_function("div", start, F.lit(1000).cast("long"))))
    return timed.withWatermark("bucket_time", late)


def streaming_bars(ticks: DataFrame, width: str, late: str = "10 minutes", in_order: bool = False) -> DataFrame:
    """As bars() on what is not later than the watermark; each bucket comes out once, in append mode."""
    return shown(_bucketed(ticks, width, late).groupBy("bucket_time", "bucket_ns").agg(*measures(in_order)))


def streaming_flow(ticks: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Records and volume of each bucket and side."""
    grouped = _bucketed(ticks.withColumn("side", side()), width, late).groupBy("bucket_time", "bucket_ns", "side").agg(F.count("*").alias("records"), volume_sum(F.col("volume_contracts")).alias("volume"))
    return grouped.select(iso(F.col("bucket_ns")).alias("bucket_start_utc"), "side", "records", checked(F.col("volume")).alias("volume"))
