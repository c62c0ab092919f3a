"""Command line: import, convert-row, query and verify."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .errors import TidemarkError, UsageError, translated
from .functions.time import parse_iso
from .operators.bars import bars, width_ns
from .operators.flow import flow
from .operators.summary import summary
from .schema import CONTRACTS, WIDTHS_NS
from .sinks import results, store
from .sources.ticks import MODES, Scan, check_range, measured, scan

#: Of each command the options that it needs and those that it takes.
OPTIONS = {
    "import": (("input", "contract"), ("data", "output")),
    "convert-row": (("data", "contract", "output"), ()),
    "query": (("data", "contract", "from", "to"), ("bucket", "scan-mode", "output", "stats")),
    "verify": (("data", "contract"), ()),
}
QUERIES = ("summary", "bars", "flow")
_VALUES = {"bucket": "|".join(WIDTHS_NS), "scan-mode": "|".join(MODES), "contract": "|".join(CONTRACTS)}


def usage() -> str:
    said = ["--version | --help"]
    for command, (needed, allowed) in OPTIONS.items():
        shown = [f"--{k} {_VALUES.get(k, k.upper())}" for k in needed] + [f"[--{k} {_VALUES.get(k, k.upper())}]" for k in allowed]
        said.append(" ".join([command, *(["|".join(QUERIES)] if command == "query" else []), *shown]))
    return "\n".join(f"tidemark {x}" for x in sorted(said))


def options(args: list[str], command: str) -> dict[str, str]:
    """Pairs of --key value; unknown, repeated, missing and empty ones are errors."""
    needed, allowed = OPTIONS[command]
    found: dict[str, str] = {}
    for k in range(0, len(args), 2):
        key = args[k].removeprefix("--")
        if not args[k].startswith("--") or key not in needed + allowed or key in found or k + 1 == len(args):
            raise UsageError(f"unknown, repeated or unfinished option: {args[k]}")
        found[key] = args[k + 1]
    for key in needed:
        if not found.get(key):
            raise UsageError(f"--{key} is missing")
    return found


def answer(spark: SparkSession, kind: str, o: dict[str, str]) -> tuple[DataFrame, Scan]:
    """The result of a query and the scan below it."""
    if kind not in QUERIES:
        raise UsageError(f"unknown query: {kind}")
    begin, end = parse_iso(o["from"]), parse_iso(o["to"])
    check_range(begin, end)
    if (kind == "bars") != ("bucket" in o):
        raise UsageError("--bucket is for bars, which need it")
    if kind == "bars":
        width_ns(o["bucket"])
    read = scan(spark, o["data"], o["contract"], begin, end, kind, o.get("scan-mode", "pruned"))
    if kind == "bars":
        return bars(read.ticks, o["bucket"], in_order=True), read
    return (summary if kind == "summary" else flow)(read.ticks, o["contract"]), read


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(args: list[str], spark: SparkSession | None = None) -> int:
    """The exit code; results go to standard output or files, errors to standard error."""
    try:
        if not args or args == ["--help"]:
            print(usage())
        elif args == ["--version"]:
            print(__version__)
        elif args[0] == "import":
            o = options(args[1:], "import")
            if ("data" in o) == ("output" in o):
                raise UsageError("import needs --data to publish in, or --output, an empty folder to fill")
            m = store.import_text(spark or session(), o["input"], o["data"], o["contract"]) if "data" in o else store.import_staging(spark or session(), o["input"], o["output"], o["contract"])
            print(json.dumps({k: m[k] for k in ("record_count", "first_timestamp_utc", "last_timestamp_utc")}))
        elif args[0] == "convert-row":
            o = options(args[1:], "convert-row")
            m = store.convert_rows(spark or session(), o["data"], o["output"], o["contract"])
            print(json.dumps({"record_count": m["record_count"], "partition_count": len(m["partitions"])}))
        elif args[0] == "verify":
            o = options(args[1:], "verify")
            print(json.dumps(store.verify(spark or session(), o["data"], o["contract"])))
        elif args[0] == "query" and len(args) > 1:
            o = options(args[2:], "query")
            results.check_outputs(o.get("output"), o.get("stats"))
            began, spark = time.perf_counter(), spark or session()
            result, source = answer(spark, args[1], o)
            rows = results.Csv(result)
            with measured(spark) as read:
                if "output" in o:
                    results.write_lines(o["output"], rows)
                else:
                    results.print_lines(rows)
            if "stats" in o:
                results.write_json(o["stats"], {"version": __version__, "query": args[1]} | source.statistics(read, rows.selected) | {"elapsed_seconds": time.perf_counter() - began})
        else:
            raise UsageError(f"unknown command: {args[0]}")
        return 0
    except Exception as fault:
        known = fault if isinstance(fault, TidemarkError) else translated(fault)
        print(f"tidemark: {known}", file=sys.stderr)
        return known.code


def main() -> None:
    sys.exit(run(sys.argv[1:]))
