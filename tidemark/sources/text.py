"""Tick text: `yyyyMMdd HHmmss fffffff;last;bid;ask;volume`, one tick a line, UTC, no header."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.numbers import money
from ..schema import DAY_NS, INT64_MAX, INT64_MIN, MAX_LINE_BYTES, NS, UINT64_MAX

#: Patterns of whole fields; `\\z` ends the input itself, unlike `$`.
TIMESTAMP = r"\A[0-9]{8} [0-9]{6} [0-9]{7}\z"
PRICE = r"\A-?[0-9]+(\.[0-9]+)?\z"
ON_GRID = r"\A-?[0-9]+(\.(0+|50*|250*|750*))?\z"
DIGITS = r"\A[0-9]+\z"


SPLITS = "split string, first_id long, n long, sha256 binary"


@dataclass(frozen=True)
class Parsed:
    """lines: all lines with the columns of a tick and reason, null where they are one; digest: of the whole source."""

    lines: DataFrame
    count: int
    digest: str

    @property
    def ticks(self) -> DataFrame:
        return self.lines.select("source_row", "timestamp_ns", "last_ticks", "bid_ticks", "ask_ticks", "volume_contracts")

    @property
    def bad(self) -> tuple[int, str] | None:
        """(row, reason) of the first line that is no tick or goes back in time; this reads the text again.

        Times are compared within a split by a window and between splits on the driver, from one row a split.
        """
        narrow = self.lines.select("split", "id", "source_row", "timestamp_ns", "reason")
        back = F.col("timestamp_ns") < F.lag("timestamp_ns").over(Window.partitionBy("split").orderBy("id"))
        checked = narrow.withColumn("reason", F.coalesce("reason", F.when(back, "timestamp goes back")))
        seen = checked.groupBy("split").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("source_row", "reason"))).alias("bad"), F.min_by("timestamp_ns", "id").alias("first"), F.max("timestamp_ns").alias("most"), F.min("source_row").alias("row")).orderBy("split").collect()
        faults, most = [], None
        for r in seen:
            if r.bad:
                faults.append((r.bad.source_row, r.bad.reason))
            if most is not None and r.first is not None and r.first < most:
                faults.append((r.row, "timestamp goes back"))
            most = max(x for x in (most, r.most, -1) if x is not None)
        return min(faults, default=None)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, id (ascending within a split), split (its file and where in it the split begins). Only `\\n` ends a line."""
    begin = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    return spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("id"), F.concat_ws("#", "_metadata.file_path", begin).alias("split"))


def splits(raw: DataFrame) -> list:
    """A row for each split, in order: its first id, its number of lines and their SHA-256, made where the split is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            values, ids = batch.column("value").to_pylist(), batch.column("id").to_pylist()
            for split, run in groupby(zip(batch.column("split").to_pylist(), range(len(ids)), strict=True), lambda x: x[0]):  # a split's lines stand together
                at = [k for _, k in run]
                own = found.setdefault(split, [ids[at[0]], 0, hashlib.sha256()])
                own[1] += len(at)
                own[2].update(b"\n".join([*values[at[0] : at[-1] + 1], b""]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[2].digest() for x in found.values()], pa.binary())],
            ["split", "first_id", "n", "sha256"],
        )

    return sorted(raw.select(F.col("value").cast("binary").alias("value"), "id", "split").mapInArrow(run, SPLITS).collect())


def digest_of(found: list) -> str:
    """SHA-256 over the digests of all splits in order: changes with any byte of a line, and with where files are split."""
    return hashlib.sha256(b"".join(b"%d:%s" % (r.n, bytes(r.sha256)) for r in found)).hexdigest()


def numbered(raw: DataFrame, found: list) -> tuple[DataFrame, int]:
    """The lines with source_row, 1 for the first, and their number: ids are shifted by split; nothing is sorted or shuffled."""
    before, rows = 0, []
    for r in found:
        rows.append((r.split, r.first_id, before))
        before += r.n
    shifts = raw.sparkSession.createDataFrame(rows, "split string, first_id long, before long")  # a row for each 128 MB of text or so
    return raw.join(F.broadcast(shifts), "split").withColumn("source_row", F.col("id") - F.col("first_id") + F.col("before") + 1), before


def price_ticks(text: Column) -> Column:
    """Quarter points of a price on the grid, null if it isn't or doesn't fit 64 bits."""
    quarters = F.when(text.rlike(ON_GRID), text.try_cast("decimal(38,2)")) * F.lit(4)
    return F.when(quarters.between(F.lit(str(INT64_MIN)).cast("decimal(20,0)"), F.lit(str(INT64_MAX)).cast("decimal(20,0)")), quarters).cast("long")


def timestamp_ns(text: Column) -> Column:
    """Nanoseconds of a source timestamp, null if it is none or no time of the calendar of 1970 to 2100."""
    ok = text.rlike(TIMESTAMP)
    part = lambda at, n: F.substring(text, at, n).try_cast("int").cast("long")
    days = F.unix_date(F.try_to_date(F.when(ok, F.substring(text, 1, 8)), "yyyyMMdd")).cast("long")
    hour, minute, second, year = part(10, 2), part(12, 2), part(14, 2), part(1, 4)
    ns = days * DAY_NS + (hour * 3600 + minute * 60 + second) * NS + part(17, 7) * 100
    return F.when(ok & year.between(1970, 2100) & (hour <= 23) & (minute <= 59) & (second <= 59), ns)


def volume(text: Column) -> Column:
    number = F.when(text.rlike(DIGITS), text.try_cast("decimal(38,0)"))
    return F.when(number <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)"), number.cast("decimal(20,0)"))


def parse(raw: DataFrame) -> DataFrame:
    """raw (value and what else it has) with the columns of a tick and reason, null for a good line."""
    body = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    f = F.split(body, ";", -1)
    out = raw.withColumn("f", f).select(*raw.columns, F.size("f").alias("n_fields"), *(F.get("f", F.lit(k)).alias(x) for k, x in enumerate(("t", "l", "b", "a", "v"))))
    out = out.select(*raw.columns, "n_fields", timestamp_ns(F.col("t")).alias("timestamp_ns"), price_ticks(F.col("l")).alias("last_ticks"), price_ticks(F.col("b")).alias("bid_ticks"), price_ticks(F.col("a")).alias("ask_ticks"), volume(F.col("v")).alias("volume_contracts"))
    reason = (
        F.when(F.octet_length("value") > MAX_LINE_BYTES, f"line is longer than {MAX_LINE_BYTES} bytes")
        .when(F.col("n_fields") != 5, "a line has five fields")
        .when(F.col("timestamp_ns").isNull(), "invalid timestamp")
        .when(F.col("last_ticks").isNull(), "invalid last price")
        .when(F.col("bid_ticks").isNull(), "invalid bid price")
        .when(F.col("ask_ticks").isNull(), "invalid ask price")
        .when(F.col("volume_contracts").isNull(), "invalid volume")
        .when((F.col("last_ticks") <= 0) | (F.col("volume_contracts") <= 0), "last price and volume must be positive")
    )
    return out.withColumn("reason", reason).drop("n_fields")


def read(spark: SparkSession, path: str) -> Parsed:
    """All lines of a text file, or of the files of a folder by name, in source order, parsed as they are read; an empty file is an error, an empty line a bad one."""
    raw = lines(spark, path)
    found = splits(raw)
    rows, count = numbered(raw, found)
    if not count:
        raise DataError(f"{path}: no ticks")
    return Parsed(parse(rows), count, digest_of(found))


def to_text(ticks: DataFrame) -> DataFrame:
    """Ticks as source lines, `value`; what read() has read comes out as the same ticks again."""
    price = lambda c: money(F.col(c)).cast("string")
    seconds = F.timestamp_seconds(F.call_function("div", F.col("timestamp_ns"), F.lit(NS).cast("long")))
    fraction = F.lpad(F.call_function("div", F.col("timestamp_ns") % NS, F.lit(100).cast("long")).cast("string"), 7, "0")
    return ticks.select(F.concat_ws(";", F.concat_ws(" ", F.date_format(seconds, "yyyyMMdd HHmmss"), fraction), price("last_ticks"), price("bid_ticks"), price("ask_ticks"), F.col("volume_contracts").cast("string")).alias("value"))
