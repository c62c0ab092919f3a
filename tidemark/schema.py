"""Types and fixed values of tick data."""

from pyspark.sql import types as T

#: Prices are counted in quarters of a point.
TICKS_PER_POINT = 4
NS = 1_000_000_000
DAY_NS = 86_400 * NS
UINT64_MAX = (1 << 64) - 1
INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
GROUP_ROWS = 65_536
MAX_LINE_BYTES = 4096
#: Contract: what its text export is called.
CONTRACTS = {"ESZ26": "ES 12-26", "NQZ26": "NQ 12-26"}
WIDTHS_NS = {"1s": NS, "1m": 60 * NS, "5m": 300 * NS, "1h": 3600 * NS, "1d": DAY_NS}

TICKS = T.StructType(
    [
        T.StructField("source_row", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("last_ticks", T.LongType()),
        T.StructField("bid_ticks", T.LongType()),
        T.StructField("ask_ticks", T.LongType()),
        T.StructField("volume_contracts", T.DecimalType(20, 0)),
    ]
)
STORED = T.StructType([*TICKS.fields, T.StructField("day", T.DateType())])
