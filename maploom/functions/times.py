"""Column functions on absolute nanoseconds and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rel_seconds(ns: Column, origin_ns: Column | int) -> Column:
    """Seconds since the origin; null stays null."""
    return (ns - origin_ns) / 1e9


def overlaps_interval(first: Column, last: Column, start: float | None, end: float | None) -> Column:
    """Whether [first, last] meets [start, end]; a missing bound is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.coalesce(last, F.lit(float("inf"))) >= start)
    if end is not None:
        out = out & (F.coalesce(first, F.lit(float("-inf"))) <= end)
    return out
