"""Alignment flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of the flags field.
BITS = {
    "is_segmented": 0x1,
    "is_properly_segmented": 0x2,
    "is_unmapped": 0x4,
    "is_mate_unmapped": 0x8,
    "is_reverse_complemented": 0x10,
    "is_mate_reverse_complemented": 0x20,
    "is_first_segment": 0x40,
    "is_last_segment": 0x80,
    "is_secondary": 0x100,
    "is_qc_fail": 0x200,
    "is_duplicate": 0x400,
    "is_supplementary": 0x800,
}
#: Records that no depth counts: unmapped, secondary, failed, duplicate.
NOT_PILED = 0x4 | 0x100 | 0x200 | 0x400


def has(flags: Column, name: str) -> Column:
    """One of the twelve predicates of ``BITS``."""
    return flags.bitwiseAND(BITS[name]) != 0


def is_piled(flags: Column) -> Column:
    return flags.bitwiseAND(NOT_PILED) == 0


def is_primary(flags: Column) -> Column:
    return flags.bitwiseAND(BITS["is_secondary"] | BITS["is_supplementary"]) == 0


def names(flags: Column) -> Column:
    """Array of the names of the set bits, in order."""
    return F.array_compact(F.array(*[F.when(has(flags, n), n) for n in BITS]))
