"""Exact prices, checked volumes, and volume-weighted means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NOT_FINITE, OVERFLOW
from ..schema import TICKS_PER_POINT, UINT64_MAX


def money(ticks: Column) -> Column:
    """Points with two decimals; null stays null."""
    return (ticks.cast("decimal(19,0)") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(21,2)")


def checked(total: Column) -> Column:
    """A sum of volumes, 0 for none; an error where it exceeds the largest unsigned 64-bit number."""
    most = F.lit(str(UINT64_MAX)).cast("decimal(20,0)")
    return F.when(total > most, F.raise_error(F.lit(OVERFLOW)).cast("decimal(20,0)")).otherwise(F.coalesce(total, F.lit(0)).cast("decimal(20,0)"))


#: Volumes and prices below these are added as longs, in halves of so many bits: sums of 2^43 rows fit.
SMALL_VOLUME, SMALL_TICKS, HALF_BITS = 1 << 16, 1 << 24, 20


def volume_sum(volume: Column) -> Column:
    """Exact sum, null for no rows. It is added as longs, large volumes in two parts: decimals cost several times as much."""
    small, part = volume.between(0, SMALL_VOLUME - 1), F.lit(SMALL_VOLUME).cast("decimal(20,0)")
    low = F.sum(F.when(small, volume.cast("long")).otherwise((volume.cast("decimal(20,0)") % part).cast("long")))
    high = F.sum(F.when(~small, F.call_function("div", volume.cast("decimal(20,0)"), part)))
    return low.cast("decimal(20,0)") + F.coalesce(high, F.lit(0)).cast("decimal(20,0)") * part.cast("decimal(5,0)")


def vwap(last: Column, volume: Column) -> Column:
    """Mean price by volume, null for no rows: by the exact sum of products, or where a large one of them or the sum of
    large ones needs more than 38 digits by the sum of doubles. Exact sums don't depend on the order of rows.

    A product of a small price and a small volume is added as two halves, longs; only any other one as a decimal.
    """
    small = volume.between(0, SMALL_VOLUME - 1) & last.between(-SMALL_TICKS, SMALL_TICKS - 1)
    product = F.when(small, last * volume.cast("long"))
    upper, lower = F.sum(F.shiftright(product, HALF_BITS)), F.sum(product.bitwiseAND(F.lit((1 << HALF_BITS) - 1)))
    wide = F.when(~small, F.try_multiply(last.cast("decimal(19,0)"), volume.cast("decimal(20,0)")))
    rough = F.sum(F.when(~small, last.cast("double") * volume.cast("double")))
    common = F.coalesce(upper, F.lit(0)).cast("decimal(20,0)") * F.lit(1 << HALF_BITS).cast("decimal(7,0)") + F.coalesce(lower, F.lit(0)).cast("decimal(20,0)")
    large = F.when(F.count(wide) == F.count(F.when(~small, last)), F.coalesce(F.try_sum(wide), F.when(rough.isNull(), F.lit(0).cast("decimal(38,0)"))))
    total = F.coalesce(F.try_add(common.cast("decimal(38,0)"), large).cast("double"), common.cast("double") + rough)
    mean = total / F.lit(float(TICKS_PER_POINT)) / F.nullif(volume_sum(volume).cast("double"), F.lit(0.0))
    return F.when(F.isnan(mean) | (F.abs(mean) == F.lit(float("inf"))), F.raise_error(F.lit(NOT_FINITE)).cast("double")).otherwise(mean)


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))
