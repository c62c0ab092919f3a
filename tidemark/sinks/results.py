"""Small results as CSV and JSON files: written beside, then renamed; nothing that exists is touched."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame

from ..errors import FileError, UsageError


class Csv:
    """Lines of a result as CSV, one partition of it on the driver at a time; nulls are blank, doubles at full precision.

    selected: the ticks that the rows given out so far were made from, by their counts.
    """

    def __init__(self, result: DataFrame):
        self.result, self.selected = result, 0
        self._counts = [c for c in result.columns if c.endswith(("record_count", "_records"))]

    def __iter__(self) -> Iterator[str]:
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(self.result.columns)
        for row in self.result.toLocalIterator():
            self.selected += sum(row[c] for c in self._counts)
            writer.writerow("" if x is None else f"{x:.17g}" if isinstance(x, float) else x for x in row)
            yield out.getvalue()
            out.seek(0)
            out.truncate()
        yield out.getvalue()


def print_lines(lines: Iterable[str]) -> None:
    """On standard output, once all of them are there."""
    with tempfile.TemporaryFile("w+", encoding="utf-8", newline="") as f:
        f.writelines(lines)
        f.seek(0)
        for line in f:
            print(line, end="")


def check_outputs(*paths: str | None) -> None:
    """No path may exist, be named twice, or be the temporary of another."""
    used = [p for path in paths if path for p in (os.path.abspath(path), os.path.abspath(f"{path}.tmp"))]
    if len(set(used)) != len(used):
        raise UsageError("output paths collide")
    for p in used:
        if os.path.lexists(p):
            raise FileError(f"{p} exists")


def write_lines(path: str, lines: Iterable[str]) -> None:
    temporary = f"{path}.tmp"
    try:
        with open(temporary, "x", encoding="utf-8", newline="") as f:
            f.writelines(lines)
        os.link(temporary, path)  # fails if path exists, unlike rename
    except OSError as fault:
        raise FileError(str(fault)) from fault
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_json(path: str, value: dict[str, Any]) -> None:
    write_lines(path, [json.dumps(value, indent=2) + "\n"])
