"""Ranges of a published dataset, in three ways of reading that give the same ticks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, UsageError
from ..functions.time import day_of, format_iso
from ..sinks.folder import Folder
from ..sinks.store import BLOCKS, check_contract, load, manifest

MODES = ("row", "column", "pruned")
#: Columns each query reads; bars need source_row too, for the order of ticks of one time.
COLUMNS = {"summary": ("timestamp_ns", "last_ticks", "volume_contracts"), "bars": ("source_row", "timestamp_ns", "last_ticks", "volume_contracts"), "flow": ("timestamp_ns", "last_ticks", "bid_ticks", "ask_ticks", "volume_contracts")}


def check_range(begin: int, end: int) -> None:
    if begin >= end:
        raise UsageError("the range is empty: from must be before to")


def in_range(ticks: DataFrame, begin: int, end: int, pushed: bool = True) -> DataFrame:
    """Ticks at begin or later, and before end. Unless pushed, in a form that Spark does not give to the reader."""
    at = F.col("timestamp_ns") if pushed else F.shiftright("timestamp_ns", 0)
    return ticks.where((at >= begin) & (at < end))


@dataclass
class Read:
    """What Spark's scans read, by its own input metrics: rows decoded, and bytes asked of the file system."""

    rows: int = 0
    bytes: int = 0


@contextmanager
def measured(spark: SparkSession) -> Iterator[Read]:
    """Fills what it gives with the metrics of all jobs that run in its block."""
    out, group, context = Read(), f"tidemark-{uuid.uuid4().hex}", spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        yield out
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty(60_000)
    for job in context.statusTracker().getJobIdsForGroup(group):
        for stage in context.statusTracker().getJobInfo(job).stageIds:
            if context.statusTracker().getStageInfo(stage):
                found = scala.statusStore().lastStageAttempt(stage)
                out.rows += found.inputRecords()
                out.bytes += found.inputBytes()


@dataclass
class Scan:
    ticks: DataFrame
    contract: str
    mode: str
    begin: int
    end: int
    path: str

    def statistics(self, read: Read, selected: int) -> dict[str, Any]:
        """What the scan examined: files and blocks by the dataset's index, the rest as measured while it ran.

        Blocks are row groups; of the row layout, which has none, those that its rows were in. All files and blocks are
        examined, as the index is read whole; those that can't hold a tick of the range are skipped in pruned mode.
        """
        blocks = self.ticks.sparkSession.read.parquet(f"{self.path}/{BLOCKS}")
        outside = (F.col("last_ns") < self.begin) | (F.col("first_ns") >= self.end)
        files, n, skipped = blocks.agg(F.countDistinct("day", "file"), F.count("*"), F.count_if(outside)).first()
        return {
            "contract": self.contract, "from_utc": format_iso(self.begin), "to_utc": format_iso(self.end), "scan_mode": self.mode,
            "files_examined": files, "blocks_examined": n, "blocks_skipped": skipped if self.mode == "pruned" else 0,
            "rows_decoded": read.rows, "rows_selected": selected, "bytes_requested": read.bytes,
        }


def scan(spark: SparkSession, root: str, contract: str, begin: int, end: int, kind: str, mode: str = "pruned", contracts: dict[str, str] | None = None) -> Scan:
    """The columns that a query of this kind needs of the ticks in [begin, end).

    pruned skips days outside the range and lets Parquet skip by its statistics; column reads the needed columns of all
    days; row reads the row-oriented copy whole. The rows of all files must be as many as the manifest has.
    """
    check_contract(contract, contracts)
    check_range(begin, end)
    if mode not in MODES:
        raise UsageError(f"scan mode must be one of {', '.join(MODES)}: {mode!r}")
    folder = Folder(spark, f"{root}/{contract}")
    layout = "row" if mode == "row" else "column"
    m = manifest(folder, contract, layout)
    ticks = load(spark, folder.path, layout)
    if ticks.count() != m["record_count"]:  # of Parquet from the footers alone
        raise DataError(f"{folder.path}: rows differ from the manifest")
    if mode == "pruned":
        ticks = ticks.where(F.col("day").between(F.lit(day_of(begin)), F.lit(day_of(end - 1))))
    ticks = in_range(ticks, begin, end, pushed=mode == "pruned").select(*COLUMNS[kind])
    return Scan(ticks, contract, mode, begin, end, folder.path)
