"""The year windows. Each statistic names one; none is recreated elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_open(start: int, end: int) -> list[int]:
    """[A, B): generic period totals; adjacent periods never share a year."""
    if end <= start:
        raise ValueError("invalid_period_interval")
    return list(range(start, end))


def after_start(start: int, end: int) -> list[int]:
    """S+1..E: rates, capital and external flows."""
    return list(range(start + 1, end + 1))


def closed(start: int, end: int) -> list[int]:
    """S..E: trade flows."""
    return list(range(start, end + 1))


def ends(start: int, end: int) -> list[int]:
    return [start, end]


def window_years(window: str, start: int, end: int | None = None) -> list[int]:
    end = start if end is None else end
    return {
        "point": lambda: [start],
        "pair": lambda: [start - 1, start],
        "ends": lambda: ends(start, end),
        "after_start": lambda: after_start(start, end),
        "closed": lambda: closed(start, end),
        "half_open": lambda: half_open(start, end),
    }[window]()


def half_open_array(start: Column, end: Column) -> Column:
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def check_years(a: int, b: int, mid: int | None = None) -> tuple[int, int | None, int]:
    """Distinct, chronological years with the middle one strictly between."""
    if a == b:
        raise ValueError("SAME_YEAR_SELECTED")
    first, last = min(a, b), max(a, b)
    if mid is not None and not first < mid < last:
        raise ValueError("INVALID_YEAR_ORDER")
    return first, mid, last


def intervals(a: int, b: int, mid: int | None = None) -> list[tuple[str, int, int]]:
    """Movement intervals: AM, MB and AB, or AB alone without a middle year."""
    a, mid, b = check_years(a, b, mid)
    if mid is None:
        return [("AB", a, b)]
    return [("AM", a, mid), ("MB", mid, b), ("AB", a, b)]
