"""Registered queries over the tick view, and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.time import bucket, day, iso, parse_iso
from ..operators.bars import bars
from ..operators.flow import flow, side
from ..operators.summary import summary
from ..schema import DAY_NS, WIDTHS_NS
from ..sinks.scratch import scratch
from ..sinks.store import contents, convert_rows, fault_counts, faults, import_text, verify
from ..sources.text import parse, read, to_text
from ..sources.ticks import in_range, scan
from .tick_view import CONTRACT, sql, ticks

#: Half-open ranges; the last holds nothing.
RANGES = {"range": ("2024-01-05T12:30:00Z", "2024-01-12T00:00:00.000000001Z"), "edge": ("2024-01-02T00:30:00Z", "2024-01-02T18:45:00Z"), "empty": ("2031-01-01T00:00:00Z", "2031-01-02T00:00:00Z")}

Query = Callable[[SparkSession, str], DataFrame]


def _ranged(spark: SparkSession, sf_dir: str, name: str | None) -> DataFrame:
    found = ticks(spark, sf_dir)
    return in_range(found, *map(parse_iso, RANGES[name])) if name else found


def _ranged_sql(name: str | None) -> str:
    if not name:
        return f"({sql()})"
    begin, end = map(parse_iso, RANGES[name])
    return f"(SELECT * FROM ({sql()}) WHERE timestamp_ns >= {begin} AND timestamp_ns < {end})"


_MONEY = "CAST(CAST({0} AS DECIMAL(19,0)) * 0.25 AS DECIMAL(21,2))"
_VWAP = "CAST(sum(CAST(last_ticks AS HUGEINT) * volume_contracts) AS DOUBLE) / 4 / CAST(sum(volume_contracts) AS DOUBLE)"
_ISO = "strftime(make_timestamp({0} // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST({0} % 1000000000 AS VARCHAR), 9, '0') || 'Z'"


def summary_sql(source: str) -> str:
    return f"SELECT '{CONTRACT}' AS contract, count(*) AS record_count, CAST(coalesce(sum(volume_contracts), 0) AS DECIMAL(20,0)) AS volume_contracts, {_MONEY.format('min(last_ticks)')} AS min_price, {_MONEY.format('max(last_ticks)')} AS max_price, CASE WHEN count(*) > 0 THEN {_VWAP} END AS vwap FROM {source}"


def bars_sql(source: str, width: str) -> str:
    w = WIDTHS_NS[width]
    order = "(timestamp_ns, source_row)"
    return f"""SELECT {_ISO.format("b")} AS bucket_start_utc, {_MONEY.format("o")} AS open, {_MONEY.format("h")} AS high, {_MONEY.format("l")} AS low, {_MONEY.format("c")} AS close, volume_contracts, record_count, vwap
 FROM (SELECT timestamp_ns // {w} * {w} AS b, arg_min(last_ticks, {order}) AS o, max(last_ticks) AS h, min(last_ticks) AS l, arg_max(last_ticks, {order}) AS c, CAST(sum(volume_contracts) AS DECIMAL(20,0)) AS volume_contracts, count(*) AS record_count, {_VWAP} AS vwap FROM {source} GROUP BY 1)"""


_SIDE = "CASE WHEN bid_ticks > 0 AND bid_ticks < ask_ticks AND last_ticks = ask_ticks THEN 'buy' WHEN bid_ticks > 0 AND bid_ticks < ask_ticks AND last_ticks = bid_ticks THEN 'sell' ELSE 'unknown' END"


def flow_sql(source: str) -> str:
    count = lambda k: f"count(*) FILTER (side = '{k}')"
    volume = lambda k: f"coalesce(sum(volume_contracts) FILTER (side = '{k}'), 0)"
    cols = [f"{count(k)} AS {n}_records" for k, n in _KINDS] + [f"CAST({volume(k)} AS DECIMAL(20,0)) AS {n}_volume" for k, n in _KINDS]
    known = f"({count('buy')} + {count('sell')})", f"({volume('buy')} + {volume('sell')})"
    return f"SELECT '{CONTRACT}' AS contract, {', '.join(cols)}, CASE WHEN count(*) > 0 THEN CAST({known[0]} AS DOUBLE) / count(*) END AS classified_record_fraction, CASE WHEN sum(volume_contracts) > 0 THEN CAST({known[1]} AS DOUBLE) / CAST(sum(volume_contracts) AS DOUBLE) END AS classified_volume_fraction FROM (SELECT *, {_SIDE} AS side FROM {source})"


_KINDS = [("buy", "estimated_buy"), ("sell", "estimated_sell"), ("unknown", "unknown")]


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("source_row", side().alias("side"))


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("source_row", *(money(F.col(f"{x}_ticks")).alias(f"{x}_price") for x in ("last", "bid", "ask")))


def _iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("source_row", iso(F.col("timestamp_ns")).alias("time_utc"))


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("source_row", *(bucket(F.col("timestamp_ns"), w).alias(f"bucket_{k}") for k, w in WIDTHS_NS.items()))


def _range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir, "range").select("source_row", "timestamp_ns", "last_ticks", "bid_ticks", "ask_ticks", "volume_contracts")


def _parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as source text and parsed again; reason is null for all of them."""
    found = ticks(spark, sf_dir)
    raw = to_text(found).select("value")
    return parse(raw).groupBy("timestamp_ns", "last_ticks", "bid_ticks", "ask_ticks", "volume_contracts", "reason").agg(F.count("*").alias("n"))


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ticks(spark, sf_dir).groupBy(day(F.col("timestamp_ns")).alias("day"))
    return found.agg(F.count("*").alias("record_count"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification counts: rows, days and faults."""
    stored = ticks(spark, sf_dir).withColumn("day", day(F.col("timestamp_ns")))
    days = contents(stored)
    return spark.createDataFrame([(sum(d["record_count"] for d in days.values()), len(days), len(faults(stored)))], "record_count long, n_days long, n_faults long")


def _crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = to_text(ticks(spark, sf_dir))
    return line.select("value", F.crc32(F.col("value").cast("binary")).alias("checksum"))


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks twice: nothing is told apart or dropped."""
    found = ticks(spark, sf_dir)
    return summary(found.unionAll(found), CONTRACT)


def _modes(pushed: bool) -> Query:
    begin, end = map(parse_iso, RANGES["range"])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ticks(spark, sf_dir)
        if pushed:
            found = found.withColumn("day", day(F.col("timestamp_ns"))).where(F.col("day").between(day(F.lit(begin)), day(F.lit(end - 1))))
        return flow(in_range(found, begin, end, pushed), CONTRACT)

    return query


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By way of a row-oriented form: text lines, parsed again."""
    raw = to_text(ticks(spark, sf_dir))
    return flow(in_range(parse(raw), *map(parse_iso, RANGES["range"]), pushed=False), CONTRACT)


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """The ticks as a text export: a folder of files whose names are in source order."""
    path = scratch(spark, "export")
    to_text(ticks(spark, sf_dir).repartitionByRange("source_row").sortWithinPartitions("source_row")).write.text(path)
    return path


def _text_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines split, numbered and parsed as on import."""
    return read(spark, _exported(spark, sf_dir)).lines.select("source_row", "timestamp_ns", "last_ticks", "bid_ticks", "ask_ticks", "volume_contracts", "reason")


def _published(spark: SparkSession, sf_dir: str, rows: bool = False) -> str:
    """A root with the ticks imported, verified and, if asked for, copied to the row layout."""
    root = scratch(spark, "published")
    import_text(spark, _exported(spark, sf_dir), root, CONTRACT, _LABELS)
    if rows:
        convert_rows(spark, root, f"{root}-rows", CONTRACT, _LABELS)
        root = f"{root}-rows"
    verify(spark, root, CONTRACT, _LABELS)
    return root


def _stored(kind: str, mode: str) -> Query:
    begin, end = map(parse_iso, RANGES["range"])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan(spark, _published(spark, sf_dir, mode == "row"), CONTRACT, begin, end, kind, mode, _LABELS).ticks
        return bars(found, "5m", in_order=True) if kind == "bars" else (flow if kind == "flow" else summary)(found, CONTRACT)

    return query


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification counts in ticks with volumes of 0, times that fall, repeated rows and a day that is wrong."""
    found = ticks(spark, sf_dir)
    row, at = F.col("source_row"), F.col("timestamp_ns")
    late = found.withColumn("timestamp_ns", F.when(row % 1000 == 7, at - 3600 * 10**9).otherwise(at)).withColumn("volume_contracts", F.when(row % 500 == 5, F.lit(0)).otherwise(F.col("volume_contracts")).cast("decimal(20,0)"))
    both = late.unionByName(late.where("source_row % 2000 = 11"))
    return fault_counts(both.withColumn("day", F.when(row % 700 == 3, F.lit("1999-01-01").cast("date")).otherwise(day(F.col("timestamp_ns")))), rows_each=777)


_LABELS = {CONTRACT: "events"}
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


for _name in (None, "range", "empty"):
    _key = _name or "full"
    _add(f"summary_{_key}", lambda s, d, r=_name: summary(_ranged(s, d, r), CONTRACT), summary_sql(_ranged_sql(_name)))
    _add(f"flow_{_key}", lambda s, d, r=_name: flow(_ranged(s, d, r), CONTRACT), flow_sql(_ranged_sql(_name)))
for _width in WIDTHS_NS:
    _add(f"bars_{_width}", lambda s, d, w=_width: bars(ticks(s, d), w, in_order=True), bars_sql(_ranged_sql(None), _width))
_add("bars_range_edge", lambda s, d: bars(_ranged(s, d, "edge"), "5m", in_order=True), bars_sql(_ranged_sql("edge"), "5m"))
_add("bars_empty", lambda s, d: bars(_ranged(s, d, "empty"), "1m", in_order=True), bars_sql(_ranged_sql("empty"), "1m"))
_add("bars_ties", lambda s, d: bars(ticks(s, d, minutes=True), "1h"), bars_sql(f"({sql(minutes=True)})", "1h"))
_add("flow_side_projection", _projection, f"SELECT source_row, {_SIDE} AS side FROM ({sql()})")
_add("money_projection", _money, f"SELECT source_row, {', '.join(f'{_MONEY.format(f"{x}_ticks")} AS {x}_price' for x in ('last', 'bid', 'ask'))} FROM ({sql()})")
_add("iso_projection", _iso, f"SELECT source_row, {_ISO.format('timestamp_ns')} AS time_utc FROM ({sql()})")
_add("bucket_projection", _buckets, f"SELECT source_row, {', '.join(f'timestamp_ns // {w} * {w} AS bucket_{k}' for k, w in WIDTHS_NS.items())} FROM ({sql()})")
_add("range_filter", _range_filter, f"SELECT source_row, timestamp_ns, last_ticks, bid_ticks, ask_ticks, CAST(volume_contracts AS DECIMAL(20,0)) AS volume_contracts FROM {_ranged_sql('range')}")
for _mode, _query in (("column", _modes(False)), ("pruned", _modes(True)), ("row", _rows)):
    # source text has 100 ns, the events' times whole microseconds, so a range that ends a nanosecond on means the same
    _add(f"scan_{_mode}", _query, flow_sql(_ranged_sql("range")))
_add("parse_roundtrip", _parse_roundtrip, f"SELECT timestamp_ns, last_ticks, bid_ticks, ask_ticks, CAST(volume_contracts AS DECIMAL(20,0)) AS volume_contracts, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM ({sql()}) GROUP BY ALL")
_add("partition_inventory", _partitions, f"SELECT CAST(make_timestamp(timestamp_ns // {DAY_NS} * {DAY_NS} // 1000) AS DATE) AS day, count(*) AS record_count, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, min(source_row) AS first_row, max(source_row) AS last_row FROM ({sql()}) GROUP BY 1")
_add("verify_counts", _verify, f"SELECT count(*) AS record_count, count(DISTINCT timestamp_ns // {DAY_NS}) AS n_days, CAST(0 AS BIGINT) AS n_faults FROM ({sql()})")
_TICK = "source_row, timestamp_ns, last_ticks, bid_ticks, ask_ticks, CAST(volume_contracts AS DECIMAL(20,0)) AS volume_contracts"
_add("text_read", _text_read, f"SELECT {_TICK}, CAST(NULL AS VARCHAR) AS reason FROM ({sql()})")
_add("store_summary_pruned", _stored("summary", "pruned"), summary_sql(_ranged_sql("range")))
_add("store_bars_column", _stored("bars", "column"), bars_sql(_ranged_sql("range"), "5m"))
_add("store_flow_row", _stored("flow", "row"), flow_sql(_ranged_sql("range")))
_add(
    "verify_faulty",
    _faulty,
    f"""WITH t AS (SELECT source_row, timestamp_ns - CASE WHEN source_row % 1000 = 7 THEN 3600000000000 ELSE 0 END AS t, CASE WHEN source_row % 500 = 5 THEN 0 ELSE volume_contracts END AS v FROM ({sql()})),
 b AS (SELECT *, lag(source_row) OVER w AS r0, lag(t) OVER w AS t0 FROM (SELECT * FROM t UNION ALL SELECT * FROM t WHERE source_row % 2000 = 11) WINDOW w AS (ORDER BY source_row, t))
 SELECT count(*) FILTER (v = 0) AS "values", CAST(0 AS BIGINT) AS nulls, count(*) FILTER (r0 = source_row) AS repeated, count(*) FILTER (t0 > t) AS falls, count(*) FILTER (source_row % 700 = 3) AS days FROM b""",
)
_add("crc32_scalar", _crc, None)
_add("duplicates_preserved", _duplicates, summary_sql(f"(SELECT * FROM ({sql()}) UNION ALL SELECT * FROM ({sql()}))"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bars_1m"](spark, sf_dir)
