"""Regions and intervals: 1-based, closed, a NULL (or None) bound is open."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTERVAL = re.compile(r"([0-9]+)(?:-([0-9]+))?")


@dataclass(frozen=True)
class Region:
    """A reference sequence and an interval of it."""

    name: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """``name[:start[-end]]``: cut at the last colon, whose right side must be an interval with positions from 1."""
        if not text:
            raise ValueError("empty region")
        name, colon, rest = text.rpartition(":")
        if not colon:
            return cls(text)
        m = _INTERVAL.fullmatch(rest)
        if not m or int(m[1]) < 1 or (m[2] is not None and int(m[2]) < 1):
            raise ValueError(f"invalid interval: {rest!r}")
        return cls(name, int(m[1]), int(m[2]) if m[2] is not None else None)

    def __str__(self) -> str:
        interval = interval_text(self.start, self.end)
        return f"{self.name}:{interval}" if interval else self.name

    def overlaps(self, name: Column, start: Column, end: Column) -> Column:
        """Whether a row's interval lies on this reference and overlaps. An unbounded region takes rows without positions."""
        on = name == F.lit(self.name)
        return on & overlaps_interval(start, end, self.start, self.end) if self.start or self.end else on


def interval_text(start: int | None, end: int | None) -> str:
    if start is None and end is None:
        return ""
    if end is None:
        return str(start)
    return f"{1 if start is None else start}-{end}"


def overlaps_interval(start: Column, end: Column, lo: int | None, hi: int | None) -> Column:
    """Overlap of ``start``..``end`` with a constant interval; only the bounds that exist are tested."""
    test = F.lit(True)
    if hi is not None:
        test = test & (start <= hi)
    if lo is not None:
        test = test & (end >= lo)
    return test & start.isNotNull() & end.isNotNull() if lo or hi else test


def contains(position: Column, start: Column, end: Column) -> Column:
    """Whether a position lies in an interval; NULL bounds are open."""
    return (start.isNull() | (position >= start)) & (end.isNull() | (position <= end))


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two intervals share a position; NULL bounds are open."""
    return (a_start.isNull() | b_end.isNull() | (a_start <= b_end)) & (b_start.isNull() | a_end.isNull() | (b_start <= a_end))


def region_columns(text: Column) -> Column:
    """Struct ``name``/``start``/``end`` of region texts; NULL where the text is no region."""
    name = F.regexp_extract(text, r"^(.*):[^:]*$", 1)
    rest = F.regexp_extract(text, r":([^:]*)\z", 1)
    start, end = F.regexp_extract(rest, "^([0-9]+)", 1).try_cast("bigint"), F.regexp_extract(rest, "-([0-9]+)$", 1).try_cast("bigint")
    whole = F.struct(text.alias("name"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    part = F.struct(name.alias("name"), start.alias("start"), end.alias("end"))
    valid = rest.rlike(r"^[0-9]+(-[0-9]+)?\z") & (start >= 1) & (end.isNull() | (end >= 1))
    return F.when(~text.contains(":") & (text != ""), whole).when(valid, part)


def region_text(name: Column, start: Column, end: Column) -> Column:
    """The text of regions."""
    interval = F.when(start.isNull() & end.isNull(), "").when(end.isNull(), F.concat(F.lit(":"), start)).otherwise(F.concat(F.lit(":"), F.coalesce(start, F.lit(1)), F.lit("-"), end))
    return F.concat(name, interval)
