"""Ticks in plain Python with exact numbers: what the engine is held against."""

from __future__ import annotations

from datetime import UTC, datetime
from fractions import Fraction

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def ticks(text: str) -> list[tuple]:
    """(row, ns, last, bid, ask, volume); prices as fractions of a point."""
    out = []
    for row, line in enumerate(text.splitlines(), 1):
        when, last, bid, ask, volume = line.split(";")
        d, t, f = when.split(" ")
        whole = datetime.strptime(d + t, "%Y%m%d%H%M%S").replace(tzinfo=UTC) - EPOCH
        out.append((row, (whole.days * 86_400 + whole.seconds) * 10**9 + int(f) * 100, Fraction(last), Fraction(bid), Fraction(ask), int(volume)))
    return out


def _vwap(found) -> float | None:
    return float(sum(x[2] * x[5] for x in found) / sum(x[5] for x in found)) if found else None


def summary(found, begin: int, end: int) -> tuple:
    found = [x for x in found if begin <= x[1] < end]
    return len(found), sum(x[5] for x in found), min((x[2] for x in found), default=None), max((x[2] for x in found), default=None), _vwap(found)


def bars(found, begin: int, end: int, width: int) -> list[tuple]:
    by: dict[int, list] = {}
    for x in found:
        if begin <= x[1] < end:
            by.setdefault(x[1] // width * width, []).append(x)
    return [(k, v[0][2], max(x[2] for x in v), min(x[2] for x in v), v[-1][2], sum(x[5] for x in v), len(v), _vwap(v)) for k, v in sorted(by.items())]


def flow(found, begin: int, end: int) -> tuple:
    n, v = {"buy": 0, "sell": 0, "unknown": 0}, {"buy": 0, "sell": 0, "unknown": 0}
    for x in found:
        if begin <= x[1] < end:
            _, _, last, bid, ask, volume = x
            side = "buy" if 0 < bid < ask and last == ask else "sell" if 0 < bid < ask and last == bid else "unknown"
            n[side] += 1
            v[side] += volume
    share = lambda d: (d["buy"] + d["sell"]) / sum(d.values()) if sum(d.values()) else None
    return (*n.values(), *v.values(), share(n), share(v))
