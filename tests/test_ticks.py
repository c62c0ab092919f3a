import random
from decimal import Decimal
from fractions import Fraction

import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.errors import UsageError
from tidemark.functions.time import format_iso, parse_iso
from tidemark.operators.bars import bars
from tidemark.operators.flow import flow
from tidemark.operators.summary import summary
from tidemark.schema import DAY_NS, NS, WIDTHS_NS
from tidemark.sources.synthetic import prefix_end_ns, synthetic_ticks
from tidemark.sources.text import lines, read, to_text
from tidemark.sources.ticks import in_range

BEGIN = "2031-05-31T23:59:00Z"
#: Quotes (last, bid, ask) of each kind: at the ask, at the bid, inside, outside, locked, crossed, not positive.
QUOTES = [("7", "6.5", "7"), ("6.50", "6.5", "7.00"), ("6.75", "6.5", "7"), ("8", "6.5", "7"), ("7", "7", "7"), ("7", "7.25", "7"), ("7", "0", "7"), ("0.25", "-3", "-0.25"), ("0.5", "-1", "0.5")]


def line(ns: int, last: str, bid: str, ask: str, volume: int) -> str:
    when = format_iso(ns)
    return f"{when[:10].replace('-', '')} {when[11:19].replace(':', '')} {when[20:27]};{last};{bid};{ask};{volume}"


def all_kinds(step_ns: int) -> str:
    """Every kind of quote twice, once each side of a midnight, the second time as repeated lines at one time."""
    begin = parse_iso(BEGIN) + 60 * NS
    before = [line(begin - (len(QUOTES) - k) * step_ns, *q, k + 1) for k, q in enumerate(QUOTES)]
    return "\n".join(before + [line(begin, *q, 3) for q in QUOTES for _ in range(2)])


def walk(seed: int, n: int) -> str:
    """A price that walks, at times that often stand still, over some minutes."""
    rng, at, price, out = random.Random(seed), parse_iso(BEGIN), 4000, []
    for _ in range(n):
        at += rng.choice([0, 0, 100, 30_000_000, 90_000_000])
        price = max(8, price + rng.randint(-3, 3))
        spread = rng.choice([-1, 0, 1, 2])
        out.append(line(at, f"{price / 4}", f"{(price - rng.randint(0, 2)) / 4}", f"{(price + spread) / 4}", rng.choice([1, 2, 9, 70_000])))
    return "\n".join(out)


def given(spark, tmp_path, text: str):
    path = tmp_path / "ticks.txt"
    path.write_bytes(text.encode())
    parsed = read(spark, str(path))
    assert parsed.bad is None
    return parsed.ticks


def close(got, want) -> bool:
    return all(g == w if w is None else g == pytest.approx(w, rel=1e-12) for g, w in zip(got, want, strict=True))


def check(ticks, expected, begin: int, end: int, in_order: bool = True, widths: tuple[str, ...] = ("1m",)) -> None:
    found = in_range(ticks, begin, end)
    (s,) = summary(found, "ESZ26").collect()
    assert tuple(s)[:5] == ("ESZ26", *oracle.summary(expected, begin, end)[:4])
    assert close([s.vwap], oracle.summary(expected, begin, end)[4:])
    for width in widths:
        got, want = bars(found, width, in_order=in_order).collect(), oracle.bars(expected, begin, end, WIDTHS_NS[width])
        assert [tuple(r)[:7] for r in got] == [(format_iso(w[0]), *w[1:7]) for w in want]
        assert close([r.vwap for r in got], [w[7] for w in want])
    (f,) = flow(found, "ESZ26").collect()
    want = oracle.flow(expected, begin, end)
    assert tuple(f)[1:7] == want[:6]
    assert close(tuple(f)[7:], want[6:])


def test_each_kind_of_quote_over_midnight(spark, tmp_path):
    text = all_kinds(100)
    ticks, midnight = given(spark, tmp_path, text.replace("\n", "\r\n", 5)), parse_iso(BEGIN) + 60 * NS
    for begin, end in [(midnight - NS, midnight + NS), (midnight - 300, midnight), (midnight, midnight + 1), (midnight + 100, midnight + DAY_NS)]:
        check(ticks, oracle.ticks(text), begin, end)


@pytest.mark.parametrize("in_order", [True, False])
def test_ties_follow_source_rows_on_any_partitions(spark, tmp_path, in_order):
    text = "\n".join(line(parse_iso(BEGIN), p, "1", "2", 1) for p in ("9", "3.25", "12", "5.5"))
    ticks = given(spark, tmp_path, text)
    for n in (1, 3):
        check(ticks.repartition(n, "last_ticks"), oracle.ticks(text), parse_iso(BEGIN), parse_iso(BEGIN) + NS, in_order)


def test_times_that_fall_are_told_apart_by_time_first(spark):
    """What no published dataset has: the row with the greater number is earlier."""
    ticks = spark.createDataFrame([(2, 100, 8, 7, 8, Decimal(1)), (1, 200, 12, 7, 8, Decimal(1))], "source_row long, timestamp_ns long, last_ticks long, bid_ticks long, ask_ticks long, volume_contracts decimal(20,0)")
    (b,) = bars(ticks, "1s").collect()
    assert (str(b.open), str(b.close)) == ("2.00", "3.00")


def test_many_splits(spark, tmp_path):
    text = walk(5, 30_000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96k")
    try:
        ticks = given(spark, tmp_path, text)
        assert lines(spark, str(tmp_path / "ticks.txt")).select("split").distinct().count() > 4
        begin = parse_iso(BEGIN)
        check(ticks, oracle.ticks(text), begin + 13 * NS + 100, begin + 77 * NS, widths=tuple(WIDTHS_NS))
        rows = ticks.orderBy("source_row").select("source_row", "volume_contracts").collect()
        assert [r.source_row for r in rows] == list(range(1, 30_001))
        assert [r.volume_contracts for r in rows] == [x[5] for x in oracle.ticks(text)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def spoiled(field: int, value: str) -> str:
    parts = line(parse_iso(BEGIN), "2", "1.75", "2", 4).split(";")
    parts[field] = value
    return ";".join(parts)


@pytest.mark.parametrize(
    "field,values,reason",
    [
        (0, ["20310431 120000 0000000", "20300229 120000 0000000", "20310401 240000 0000000", "20310401 126100 0000000", "20310401 120060 0000000", "19690101 120000 0000000", "21010101 120000 0000000", "20310401 120000 000000", "20310401 12000 00000000", " 20310401 120000 0000000", ""], "timestamp"),
        (1, ["2.2", "2.125", "2.", ".75", "+2", " 2", "2e0", "inf", "--2", "", "9" * 22], "last price"),
        (2, ["1.80", "1,75", "-", "0x1"], "bid price"),
        (3, ["2.6", "-.5", "2 "], "ask price"),
        (4, ["-4", "4.5", "+4", "", "٤", str(1 << 64)], "volume"),
        (4, ["0", "000"], "positive"),
        (1, ["0", "-0.25"], "positive"),
        (4, ["4;", "4;5"], "fields"),
        (4, ["4\r\r"], "volume"),
        (4, ["4" * 4080], "4096"),
    ],
)
def test_bad_fields(spark, tmp_path, field, values, reason):
    path = tmp_path / "bad.txt"
    path.write_bytes("\n".join(spoiled(field, value) for value in values).encode())
    got = {r.source_row: r.reason for r in read(spark, str(path)).lines.collect()}
    for k, value in enumerate(values, 1):
        assert reason in got[k], value


def test_the_first_bad_line_is_told(spark, tmp_path):
    good, later, earlier = (line(parse_iso(BEGIN) + k * NS, "2", "1", "2", 1) for k in (0, 1, -1))
    path = tmp_path / "bad.txt"
    for text, row, reason in [([good, "", later], 2, "fields"), ([good, later, good], 3, "goes back"), ([good, "?", earlier], 2, "fields"), ([later, good, "?"], 2, "goes back"), ([good, spoiled(1, "000002.750000")], None, None)]:
        path.write_text("\n".join(text))
        bad = read(spark, str(path)).bad
        assert bad is None if row is None else bad[0] == row and reason in bad[1]


def test_extremes_and_overflow(spark, tmp_path):
    at, price = parse_iso(BEGIN), f"{(1 << 63) // 4 - 1}.75"  # the greatest 64-bit count of quarters
    text = "\n".join([line(at, price, "1", price, (1 << 64) - 1), line(at + NS, "3", "2", "3", 1)])
    ticks = given(spark, tmp_path, text)
    check(ticks, oracle.ticks(text), at, at + NS)
    assert bars(ticks, "1s").count() == 2  # each bucket holds one
    for query in (summary(ticks, "ESZ26"), flow(ticks, "ESZ26"), bars(ticks, "1d").where("open < 9")):
        with pytest.raises(Exception, match="overflow"):
            query.collect()
            bars(ticks.withColumn("timestamp_ns", F.lit(at)), "1d").collect()


def test_large_and_small_values_add_up_exactly(spark):
    """Either way of adding, and both in one bucket, against whole numbers."""
    rng = random.Random(3)
    rows = [(k, 5, rng.choice([rng.randint(1, 400), rng.randint(1 << 24, 1 << 40)]), Decimal(rng.choice([rng.randint(1, 9), (1 << 16) - 1, 1 << 16, rng.randint(1 << 16, 1 << 45)]))) for k in range(500)]
    ticks = spark.createDataFrame(rows, "source_row long, timestamp_ns long, last_ticks long, volume_contracts decimal(20,0)").repartition(5)
    (s,) = summary(ticks, "X").collect()
    assert s.volume_contracts == sum(r[3] for r in rows)
    assert s.vwap == pytest.approx(float(Fraction(sum(r[2] * int(r[3]) for r in rows), 4 * int(sum(r[3] for r in rows)))), rel=1e-15)
    assert summary(ticks.repartition(3, "last_ticks"), "X").first().vwap == s.vwap


def test_synthetic(spark):
    ticks = synthetic_ticks(spark, 1000)
    (s,) = summary(ticks, "X").collect()
    assert [str(x) for x in s[1:5]] == ["1000", "3000", "10000.25", "10249.00"]
    assert s.vwap == pytest.approx(10125.041666666666, rel=1e-12)
    (b,) = bars(ticks, "1m").collect()
    assert [str(x) for x in b[1:5]] == ["10182.75", "10249.00", "10000.25", "10121.50"]
    assert to_text(ticks).first().value == "20260909 000000 0000000;10182.75;10182.50;10182.75;1"
    assert in_range(synthetic_ticks(spark, 5000), parse_iso("2026-09-09T00:00:00Z"), prefix_end_ns(5000)).count() == 50


@pytest.mark.parametrize("text", ["2031-04-01", "2031-04-31T00:00:00Z", "1969-12-31T23:59:59Z", "2101-01-01T00:00:00Z", "2031-04-01T00:00:00.Z", "2031-04-01T00:00:00.0000000001Z", "2031-04-01T25:00:00Z", "2031-04-01T00:00:00+00:00", "2031-04-01t00:00:00z", "\u06622031-4-1T00:00:00Z"])
def test_bounds_that_are_none(text):
    with pytest.raises(UsageError):
        parse_iso(text)


def test_bounds_round_trip():
    for text in ("1970-01-01T00:00:00.000000000Z", "2100-12-31T23:59:59.999999999Z"):
        assert format_iso(parse_iso(text)) == text


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_what_they_need(spark, tmp_path):
    given(spark, tmp_path, all_kinds(100)).write.parquet(str(tmp_path / "p"))
    read_back = in_range(spark.read.parquet(str(tmp_path / "p")), 0, 10)
    plan = plan_of(summary(read_back, "ESZ26"))
    assert "GreaterThanOrEqual(timestamp_ns,0)" in plan
    assert "bid_ticks" not in plan
    plan = plan_of(bars(read_back, "1m", ordered=False, in_order=True))
    assert plan.count("Exchange") == 1
    assert "HashAggregate" in plan
    assert "SortAggregate" not in plan
    assert "Sort " not in plan


def test_streaming_bars_match_batch(spark, tmp_path):
    from tidemark.streaming.bars import streaming_bars, streaming_flow

    ticks = synthetic_ticks(spark, 2000).withColumn("timestamp_ns", F.col("timestamp_ns") + F.col("source_row") * 1_000_000_000)
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = ticks.where("source_row = 2000").withColumn("timestamp_ns", F.col("timestamp_ns") + 86_400 * 10**9)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, made in (("b", lambda t, w: streaming_bars(t, w, in_order=True)), ("f", streaming_flow)):
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = made(stream, "1m").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        query.processAllAvailable()
        query.stop()
    got = {r.bucket_start_utc: tuple(r) for r in spark.table("b").collect()}
    want = {r.bucket_start_utc: tuple(r) for r in bars(ticks, "1m").collect()}
    assert got == want
    assert sum(r.records for r in spark.table("f").collect()) == 2000
