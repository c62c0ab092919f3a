"""Open, high, low and close by epoch-aligned buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UsageError
from ..functions.numbers import checked, money, volume_sum, vwap
from ..functions.time import bucket, iso
from ..schema import WIDTHS_NS


def width_ns(width: str) -> int:
    if width not in WIDTHS_NS:
        raise UsageError(f"bucket must be one of {', '.join(WIDTHS_NS)}: {width!r}")
    return WIDTHS_NS[width]


def measures(in_order: bool) -> list[Column]:
    """The aggregates of a bar; see bars()."""
    last, volume = F.col("last_ticks"), F.col("volume_contracts")
    place = F.col("source_row") if in_order else F.struct("timestamp_ns", "source_row")
    return [F.min_by(last, place).alias("open"), F.max(last).alias("high"), F.min(last).alias("low"), F.max_by(last, place).alias("close"), volume_sum(volume).alias("volume"), F.count("*").alias("record_count"), vwap(last, volume).alias("vwap")]


def shown(grouped: DataFrame) -> DataFrame:
    return grouped.select(iso(F.col("bucket_ns")).alias("bucket_start_utc"), *(money(F.col(x)).alias(x) for x in ("open", "high", "low", "close")), checked(F.col("volume")).alias("volume_contracts"), "record_count", "vwap")


def bars(ticks: DataFrame, width: str, ordered: bool = True, in_order: bool = False) -> DataFrame:
    """A row for each bucket with ticks, in order of time unless not wanted.

    Open and close are the first and last tick by (timestamp_ns, source_row), whatever the partitions. in_order says
    that times never fall along source rows, as in every published dataset (import refuses others, verify tells): then
    source_row alone orders ticks, and as it is a plain number the plan is hash aggregates, partial ones before the one
    shuffle. A pair has no place in a hash aggregate's buffer: without in_order Spark sorts each task's ticks by bucket.
    """
    grouped = ticks.groupBy(bucket(F.col("timestamp_ns"), width_ns(width)).alias("bucket_ns")).agg(*measures(in_order))
    return shown(grouped.orderBy("bucket_ns") if ordered else grouped)
