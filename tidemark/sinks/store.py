"""Immutable datasets of ticks: Parquet by UTC day with a manifest, published by one rename, verified on demand."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..errors import DataError, FileError, TidemarkError, UsageError, translated
from ..functions.time import day, format_iso
from ..schema import CONTRACTS, GROUP_ROWS, STORED
from ..sources import text
from .folder import Folder

MANIFEST, BLOCKS = "_manifest.json", "_blocks"
MANIFEST_BYTES, MANIFEST_DEPTH = 1 << 20, 16
READ_OPTIONS = {"parquet.page.verify-checksum.enabled": "true"}


def check_contract(contract: str, contracts: dict[str, str] | None = None) -> str:
    known = CONTRACTS if contracts is None else contracts
    if contract not in known:
        raise UsageError(f"contract must be one of {', '.join(known)}: {contract!r}")
    return known[contract]


def _strict(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _depth(x: Any) -> int:
    return 1 + max(map(_depth, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, dict | list) else 0


def _whole_text(x: Any) -> None:
    """Half of a surrogate pair, which an escape can name, is no character."""
    for part in [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, list) else []:
        _whole_text(part)
    if isinstance(x, str):
        x.encode()


def _no_constant(x: str) -> None:
    raise ValueError(f"{x} is no JSON")


def manifest(folder: Folder, contract: str, layout: str | None = None) -> dict[str, Any]:
    """The manifest, checked: its JSON, its fields, and the days it lists against those that are there."""
    if not folder.exists(MANIFEST):
        raise FileError(f"{folder.path}: no published dataset")
    try:
        m = json.loads(folder.read(MANIFEST, MANIFEST_BYTES), object_pairs_hook=_strict, parse_constant=_no_constant)
        if _depth(m) > MANIFEST_DEPTH:
            raise ValueError("nested too deep")
        _whole_text(m)
    except (ValueError, FileError, RecursionError) as fault:
        raise DataError(f"{folder.path}: manifest: {fault}") from None
    days = m.get("partitions") if isinstance(m, dict) else None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    if not isinstance(days, list) or not days or m.get("schema_version") != 1 or m.get("contract") != contract or not whole(m.get("record_count")) or m.get("storage_layout", "column") not in ("column", "row"):
        raise DataError(f"{folder.path}: manifest: a field is missing or wrong")
    names = [d.get("name") if isinstance(d, dict) else None for d in days]
    if not all(isinstance(n, str) for n in names) or len(set(names)) != len(names) or not all(whole(d.get("record_count")) for d in days) or sum(d["record_count"] for d in days) != m["record_count"]:
        raise DataError(f"{folder.path}: manifest: partitions are wrong")
    if sorted(names) != [n for n in folder.names() if not n.startswith(("_", "."))]:
        raise DataError(f"{folder.path}: partitions differ from the manifest's")
    if layout and m.get("storage_layout", "column") != layout:
        raise UsageError(f"{folder.path} has the {m.get('storage_layout', 'column')} layout, not {layout}")
    return m


def load(spark: SparkSession, path: str, layout: str = "column") -> DataFrame:
    """All ticks of a dataset, with day; page checksums are verified."""
    if layout == "row":
        return spark.read.schema(STORED).option("mode", "FAILFAST").csv(path)
    return spark.read.schema(STORED).options(**READ_OPTIONS).parquet(path)


def write_days(ticks: DataFrame, path: str, in_order: bool = False) -> None:
    """Ticks by day, each file a range of source rows in order, in row groups small enough to skip.

    in_order: each task has a range of source rows already, as tasks that read splits of a text have; nothing is shuffled.
    """
    ordered = ticks.withColumn("day", day(F.col("timestamp_ns")))
    ordered = (ordered if in_order else ordered.repartitionByRange("source_row")).sortWithinPartitions("day", "source_row")
    ordered.write.mode("append").option("parquet.block.row.count.limit", GROUP_ROWS).option("parquet.page.row.count.limit", 8192).partitionBy("day").parquet(path)


def blocks(stored: DataFrame) -> DataFrame:
    """A row for each row group, as write_days makes them: day, file, block, rows, and first and last time."""
    at = F.call_function("div", F.col("_metadata.row_index"), F.lit(GROUP_ROWS).cast("long"))
    return stored.groupBy("day", F.col("_metadata.file_name").alias("file"), at.alias("block")).agg(F.count("*").alias("rows"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def contents(stored: DataFrame) -> dict[str, dict[str, Any]]:
    """Of each day: rows, first and last time, and a digest of all values that does not depend on order or files."""
    rows = stored.groupBy("day").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first"), F.max("timestamp_ns").alias("last"), F.bit_xor(F.xxhash64(*[f.name for f in STORED.fields])).alias("mix"), F.sum(F.xxhash64(*[f.name for f in STORED.fields]).cast("decimal(20,0)")).alias("total")).collect()
    return {f"day={r.day}": {"name": f"day={r.day}", "record_count": r.n, "first_ns": r.first, "last_ns": r.last, "digest": f"{r.mix & (1 << 64) - 1:016x}{int(r.total) & (1 << 64) - 1:016x}"} for r in rows}


#: What fault_counts counts, in words.
FAULTS = {"values": "values that are not positive", "nulls": "missing values", "repeated": "repeated source rows", "falls": "times that fall", "days": "rows of another day"}


def fault_counts(stored: DataFrame, rows_each: int = 1_000_000) -> DataFrame:
    """One row, FAULTS: what is wrong with ticks as a whole, values and order; nothing is gathered but a row for each rows_each rows.

    Source rows must rise and times must not fall along them. Rows are compared with the one before within runs of
    source rows, and the runs by their ends.
    """
    run = F.call_function("div", F.col("source_row"), F.lit(rows_each).cast("long"))
    before = Window.partitionBy("run").orderBy("source_row", "timestamp_ns")
    ranked = stored.withColumn("run", run).withColumn("row_before", F.lag("source_row").over(before)).withColumn("time_before", F.lag("timestamp_ns").over(before))
    runs = ranked.groupBy("run").agg(
        F.count_if((F.col("source_row") <= 0) | (F.col("last_ticks") <= 0) | (F.col("volume_contracts") <= 0)).alias("values"),
        F.count_if(F.greatest(*(F.col(f.name).isNull().cast("int") for f in STORED.fields)) == 1).alias("nulls"),
        F.count_if(F.col("row_before") == F.col("source_row")).alias("repeated"),
        F.count_if(F.col("time_before") > F.col("timestamp_ns")).alias("falls"),
        F.count_if(F.col("day") != day(F.col("timestamp_ns"))).alias("days"),
        F.min_by("timestamp_ns", "source_row").alias("first"),
        F.max_by("timestamp_ns", "source_row").alias("last"),
    )
    falls_here = F.coalesce((F.lag("last").over(Window.orderBy("run")) > F.col("first")).cast("long"), F.lit(0))
    ends = runs.withColumn("falls", F.col("falls") + falls_here)
    return ends.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in FAULTS))


def faults(stored: DataFrame) -> list[str]:
    """The faults that were found, in words."""
    found = fault_counts(stored).first()
    return [f"{found[k]} {what}" for k, what in FAULTS.items() if found[k]]


def verify(spark: SparkSession, root: str, contract: str, contracts: dict[str, str] | None = None) -> dict[str, Any]:
    """Read everything of a dataset and hold it against the manifest and the rules of ticks."""
    check_contract(contract, contracts)
    folder = Folder(spark, f"{root}/{contract}")
    m = manifest(folder, contract)
    try:
        stored = load(spark, folder.path, m.get("storage_layout", "column"))
        found = contents(stored)
        if found != {d["name"]: d for d in m["partitions"]}:
            raise DataError(f"{folder.path}: contents differ from the manifest")
        if wrong := faults(stored):
            raise DataError(f"{folder.path}: {'; '.join(wrong)}")
    except Exception as fault:
        raise translated(fault) from fault
    return {"contract": contract, "record_count": m["record_count"]}


def _publish(spark: SparkSession, root: str, contract: str, fill) -> dict[str, Any]:
    """fill(staging path) writes the days and gives the manifest; then one rename makes all of it visible, or nothing is."""
    folder = Folder(spark, root)
    folder.make()
    if folder.exists(contract):
        raise FileError(f"{folder.path}/{contract} exists and is immutable")
    staging = f".{contract}.staging-{uuid.uuid4().hex}"
    try:
        m = fill(f"{folder.path}/{staging}")
        own = Folder(spark, f"{folder.path}/{staging}")
        if own.exists("_SUCCESS"):
            own.remove("_SUCCESS")
        own.write(MANIFEST, json.dumps(m, indent=2) + "\n")
        folder.rename(staging, contract)
        return m
    except Exception as fault:
        raise translated(fault) from fault
    finally:
        if folder.exists(staging):
            folder.remove(staging)


def _written(spark: SparkSession, source: str, folder: str) -> tuple[dict[str, dict[str, Any]], dict[str, Any]]:
    """Write the ticks of a text export to a folder and hold what was written against it; its days, and what is known of the source."""
    file = Folder(spark, source)
    if not file.exists():
        raise FileError(f"{source}: no such file")
    identity = file.identity()
    parsed = text.read(spark, source)
    seen = Observation()
    write_days(parsed.lines.observe(seen, F.count_if(F.col("reason").isNotNull()).alias("bad")).select(*parsed.ticks.columns), folder, in_order=True)
    stored = load(spark, folder)
    wrong = seen.get["bad"] or faults(stored)
    if wrong and (bad := parsed.bad):
        raise DataError(f"{source}:{bad[0]}: {bad[1]}")
    days = contents(stored)
    if wrong or sum(d["record_count"] for d in days.values()) != parsed.count:
        raise DataError(f"{source}: written ticks differ from the source: {wrong}")
    if file.identity() != identity or text.digest_of(text.splits(text.lines(spark, source))) != parsed.digest:
        raise DataError(f"{source} changed while it was read")
    return days, {"source_name": source.rsplit("/", 1)[-1], "source_split_sha256": parsed.digest, "source_split_bytes": spark.conf.get("spark.sql.files.maxPartitionBytes"), "source_bytes": identity[0], "source_mtime_ns": identity[1] * 1_000_000, "record_count": parsed.count}


def import_text(spark: SparkSession, source: str, root: str, contract: str, contracts: dict[str, str] | None = None) -> dict[str, Any]:
    """Publish a text export as <root>/<contract>: parsed and written in one pass, read again and compared, the source unchanged meanwhile."""
    label = check_contract(contract, contracts)

    def fill(staging: str) -> dict[str, Any]:
        days, known = _written(spark, source, staging)
        blocks(load(spark, staging)).coalesce(1).write.parquet(f"{staging}/{BLOCKS}")
        partitions = [days[k] for k in sorted(days)]
        return {
            "schema_version": 1, "contract": contract, "storage_layout": "column", "source_label": label, **known,
            "first_timestamp_utc": format_iso(min(d["first_ns"] for d in partitions)), "last_timestamp_utc": format_iso(max(d["last_ns"] for d in partitions)),
            "timestamp_timezone": "UTC", "timestamp_unit": "nanoseconds", "source_fraction_digits": 7, "price_tick_size": "0.25", "volume_unit": "contracts", "duplicates": "preserved",
            "engine_version": __version__, "imported_at_utc": datetime.now(UTC).isoformat(), "partitions": partitions,
        }

    return _publish(spark, root, contract, fill)


def import_staging(spark: SparkSession, source: str, output: str, contract: str, contracts: dict[str, str] | None = None) -> dict[str, Any]:
    """Fill an existing empty folder with the days of a text export, checked as on import, without publishing it."""
    check_contract(contract, contracts)
    folder = Folder(spark, output)
    if not folder.exists() or folder.names():
        raise FileError(f"{output} must be an existing empty folder")
    try:
        days, known = _written(spark, source, output)
    except Exception as fault:
        raise translated(fault) from fault
    return {"record_count": known["record_count"], "first_timestamp_utc": format_iso(min(d["first_ns"] for d in days.values())), "last_timestamp_utc": format_iso(max(d["last_ns"] for d in days.values()))}


def convert_rows(spark: SparkSession, source_root: str, root: str, contract: str, contracts: dict[str, str] | None = None) -> dict[str, Any]:
    """Publish a row-oriented copy (CSV by day) of a column dataset; read again, it must hold just the same ticks.

    Its manifest and the digests of all its days are taken before and after; the index of blocks comes along.
    """
    check_contract(contract, contracts)
    folder = Folder(spark, f"{source_root}/{contract}")
    parent = manifest(folder, contract, "column")
    digest = folder.sha256(MANIFEST)
    want = {d["name"]: d for d in parent["partitions"]}

    def fill(staging: str) -> dict[str, Any]:
        source = load(spark, folder.path)
        if contents(source) != want:
            raise DataError(f"{folder.path}: contents differ from the manifest")
        source.write.partitionBy("day").csv(staging)
        copy = load(spark, staging, "row")
        both = source.withColumn("side", F.lit(1)).unionByName(copy.withColumn("side", F.lit(-1)))
        if not both.groupBy(*STORED.names).agg(F.sum("side").alias("left")).where(F.col("left") != 0).isEmpty():
            raise DataError(f"{folder.path}: the copy differs")
        if folder.exists(BLOCKS):
            spark.read.parquet(f"{folder.path}/{BLOCKS}").coalesce(1).write.parquet(f"{staging}/{BLOCKS}")
        if folder.sha256(MANIFEST) != digest or contents(load(spark, folder.path)) != want:
            raise DataError(f"{folder.path} changed while it was read")
        return parent | {"storage_layout": "row", "parent_manifest_sha256": digest, "conversion_engine_version": __version__, "converted_at_utc": datetime.now(UTC).isoformat()}

    return _publish(spark, root, contract, fill)


__all__ = ["TidemarkError", "blocks", "contents", "convert_rows", "faults", "import_staging", "import_text", "load", "manifest", "verify"]
