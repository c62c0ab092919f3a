"""Which side took the trade, estimated from the quotes in the tick's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import checked, share, volume_sum


def side() -> Column:
    """`buy` at the ask, `sell` at the bid, of a valid quote (0 < bid < ask); everything else is `unknown`."""
    last, bid, ask = F.col("last_ticks"), F.col("bid_ticks"), F.col("ask_ticks")
    valid = (bid > 0) & (bid < ask)
    return F.when(valid & (last == ask), "buy").when(valid & (last == bid), "sell").otherwise("unknown")


def flow(ticks: DataFrame, contract: str) -> DataFrame:
    """Counts and volumes by side, and the shares that have one; one row even of no ticks, its shares null then."""
    sided = ticks.withColumn("side", side())
    kinds = {"buy": "estimated_buy", "sell": "estimated_sell", "unknown": "unknown"}
    totals = sided.agg(
        *(F.count_if(F.col("side") == k).alias(f"{name}_records") for k, name in kinds.items()),
        *(F.coalesce(volume_sum(F.when(F.col("side") == k, F.col("volume_contracts"))), F.lit(0)).alias(f"{name}_volume") for k, name in kinds.items()),
        F.count("*").alias("records"),
        volume_sum(F.col("volume_contracts")).alias("all_volume"),
    )
    # each side's sum is at most that of all, so the check of that one holds for them
    volume = checked(F.col("all_volume"))
    return totals.select(
        F.lit(contract).alias("contract"),
        *(f"{name}_records" for name in kinds.values()),
        *(F.col(f"{name}_volume").cast("decimal(20,0)").alias(f"{name}_volume") if name != "unknown" else F.when(volume >= 0, F.col("unknown_volume")).cast("decimal(20,0)").alias("unknown_volume") for name in kinds.values()),
        share(F.col("estimated_buy_records") + F.col("estimated_sell_records"), F.col("records")).alias("classified_record_fraction"),
        share(F.col("estimated_buy_volume") + F.col("estimated_sell_volume"), volume).alias("classified_volume_fraction"),
    )
