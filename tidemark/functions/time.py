"""UTC times as nanoseconds since 1970: bounds on the driver, columns on the executors."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UsageError
from ..schema import DAY_NS, NS

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?Z", re.ASCII)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def parse_iso(text: str) -> int:
    """Nanoseconds of `YYYY-MM-DDTHH:MM:SS[.fraction]Z`, of the years 1970 to 2100, up to nine digits of fraction."""
    m = _ISO.fullmatch(text)
    try:
        if not m or not 1970 <= int(m[1]) <= 2100:
            raise ValueError
        whole = datetime(*(int(x) for x in m.groups()[:6]), tzinfo=UTC) - _EPOCH
    except ValueError:
        raise UsageError(f"not a UTC time of the form 2026-01-31T12:00:00Z: {text!r}") from None
    return (whole.days * 86_400 + whole.seconds) * NS + int((m[7] or "").ljust(9, "0"))


def format_iso(ns: int) -> str:
    return f"{_EPOCH + timedelta(seconds=ns // NS):%Y-%m-%dT%H:%M:%S}.{ns % NS:09d}Z"


def day_of(ns: int) -> date:
    return (_EPOCH + timedelta(days=ns // DAY_NS)).date()


def iso(ns: Column) -> Column:
    """The time as text with nine digits of fraction; the session's time zone is UTC."""
    seconds = F.timestamp_seconds(_div(ns, NS))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss."), F.lpad((ns % F.lit(NS)).cast("string"), 9, "0"), F.lit("Z"))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def bucket(ns: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket of the given width that a time falls into."""
    return _div(ns, width) * F.lit(width)


def day(ns: Column) -> Column:
    return F.date_from_unix_date(_div(ns, DAY_NS).cast("int"))
