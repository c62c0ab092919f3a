"""One row of totals over ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import checked, money, volume_sum, vwap


def summary(ticks: DataFrame, contract: str) -> DataFrame:
    """Count, volume, least and greatest price and vwap; one row even of no ticks, its prices null then."""
    last, volume = F.col("last_ticks"), F.col("volume_contracts")
    totals = ticks.agg(
        F.count("*").alias("record_count"), volume_sum(volume).alias("volume"), F.min(last).alias("low"), F.max(last).alias("high"), vwap(last, volume).alias("vwap")
    )
    return totals.select(F.lit(contract).alias("contract"), "record_count", checked(F.col("volume")).alias("volume_contracts"), money(F.col("low")).alias("min_price"), money(F.col("high")).alias("max_price"), "vwap")
