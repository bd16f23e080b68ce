"""Hierarchical bins of binning indexes: level ``l`` has ``8 ** l`` bins, the last one ``2 ** min_shift`` positions wide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SHIFT, DEPTH = 14, 5
UNMAPPED_BIN = 4680
"""Bin of a record without a position in the fixed scheme."""


def first_bin(level: int) -> int:
    """The first bin of a level."""
    return ((1 << 3 * level) - 1) // 7


def bin_limit(depth: int = DEPTH) -> int:
    """One more than the last bin."""
    return first_bin(depth + 1)


def metadata_bin(depth: int = DEPTH) -> int:
    """The pseudo-bin that holds counts instead of records."""
    return bin_limit(depth) + 1


def max_position(min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    return (1 << (min_shift + 3 * depth)) - 1


def parent(bin_: Column) -> Column:
    """The parent of a bin; NULL for the root."""
    return F.when(bin_ > 0, F.shiftright(bin_ - 1, 3))


def reg2bin(start: Column, end: Column, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> Column:
    """The smallest bin that holds the closed interval ``start``..``end`` (from 1)."""
    begin, last = start.cast("bigint") - 1, end.cast("bigint") - 1
    found = F.lit(0).cast("bigint")
    for level in range(1, depth + 1):  # the deepest level is tested first
        shift = min_shift + 3 * (depth - level)
        found = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), F.lit(first_bin(level)) + F.shiftright(begin, shift)).otherwise(found)
    return found.cast("int")


def bam_bin(start: Column, end: Column) -> Column:
    """The 16-bit bin of a stored alignment record."""
    return F.when(start.isNull(), UNMAPPED_BIN).otherwise(reg2bin(start, end).bitwiseAND(0xFFFF))


def reg2bins(start: Column, end: Column, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> Column:
    """All bins that may hold records overlapping ``start``..``end``, ascending."""
    begin, last = start.cast("bigint") - 1, end.cast("bigint") - 1
    levels = []
    for level in range(depth + 1):
        shift = min_shift + 3 * (depth - level)
        levels.append(F.sequence(F.lit(first_bin(level)) + F.shiftright(begin, shift), F.lit(first_bin(level)) + F.shiftright(last, shift)))
    return F.transform(F.flatten(F.array(*levels)), lambda b: b.cast("int"))


def plain_reg2bins(start: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> list[int]:
    """``reg2bins`` of plain numbers."""
    out = []
    for level in range(depth + 1):
        shift = min_shift + 3 * (depth - level)
        out += range(first_bin(level) + ((start - 1) >> shift), first_bin(level) + ((end - 1) >> shift) + 1)
    return out


def plain_reg2bin(start: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """``reg2bin`` of plain numbers."""
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        if (start - 1) >> shift == (end - 1) >> shift:
            return first_bin(level) + ((start - 1) >> shift)
    return 0
