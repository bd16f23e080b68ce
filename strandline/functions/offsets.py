"""Offsets into block-compressed and indexed files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def virtual_position(compressed: Column, uncompressed: Column) -> Column:
    """48 bits of offset of a block and 16 bits within it, as decimal (the packed value may exceed a signed long)."""
    return compressed.cast("decimal(20,0)") * 65536 + uncompressed.cast("decimal(20,0)")


def unpacked(position: Column) -> Column:
    """Struct ``coffset``/``uoffset`` of a packed virtual position."""
    p = position.cast("decimal(20,0)")
    return F.struct(F.floor(p / 65536).cast("bigint").alias("coffset"), (p % 65536).cast("int").alias("uoffset"))


def fai_offset(position: Column, line_bases: Column, line_width: Column, start: Column) -> Column:
    """Byte of the 1-based base ``start`` in a file of lines of equal length."""
    zero = start.cast("bigint") - 1
    return position + F.floor(zero / line_bases).cast("bigint") * line_width + zero % line_bases
