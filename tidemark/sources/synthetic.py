"""Synthetic ticks by a fixed formula, as many as asked for, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UsageError

#: 2026-09-09T00:00:00Z, and the formula of the price.
BEGIN_NS = 1_788_912_000_000_000_000
MOST_ROWS = 100_000_000


def synthetic_ticks(spark: SparkSession, rows: int, partitions: int | None = None, step_ns: int = 100) -> DataFrame:
    """Two ticks each step_ns; price 40000 + (1103515245 i + 731) mod 1000 quarters at the ask, a quarter over the bid."""
    if not 1 <= rows <= MOST_ROWS:
        raise UsageError(f"rows must be 1 to {MOST_ROWS}")
    i = F.col("id")
    last = F.lit(40_000).cast("long") + F.pmod(i * 1_103_515_245 + 731, F.lit(1000).cast("long"))
    source = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return source.select((i + 1).alias("source_row"), (F.lit(BEGIN_NS) + F.call_function("div", i, F.lit(2).cast("long")) * step_ns).alias("timestamp_ns"), last.alias("last_ticks"), (last - 1).alias("bid_ticks"), last.alias("ask_ticks"), (i % 5 + 1).cast("decimal(20,0)").alias("volume_contracts"))


def prefix_end_ns(rows: int) -> int:
    """End of a range that starts with the first tick and holds one in a hundred."""
    return BEGIN_NS + rows // 100 // 2 * 100
