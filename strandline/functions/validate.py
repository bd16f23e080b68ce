"""Validators of the fields that writers accept, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_read_name(name: Column) -> Column:
    """1 to 254 visible characters other than ``@``."""
    return name.rlike(r"^[!-?A-~]{1,254}\z")


def is_reference_name(name: Column) -> Column:
    """Visible characters, none of ``\\ , " ` ' ( ) [ ] { } < >``, and no ``*`` or ``=`` at the start."""
    return name.rlike(r"""^[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*+\z""")


def is_sequence(seq: Column) -> Column:
    """Letters, ``=`` and ``.`` only."""
    return seq.rlike(r"^[A-Za-z=.]*+\z")


def is_quality(quality: Column, seq: Column) -> Column:
    """Scores 0 to 93 in the text form, as many as bases."""
    return quality.rlike(r"^[!-~]*+\z") & (F.length(quality) == F.length(seq))


def is_feature_name(name: Column) -> Column:
    """1 to 255 printable characters."""
    return name.rlike(r"^[ -~]{1,255}\z")


def checked(value: Column, valid: Column, what: str) -> Column:
    """``value`` where it is NULL or valid; anything else raises."""
    error = F.raise_error(F.concat(F.lit(f"invalid {what}: "), value.cast("string"))).cast("string")
    return F.when(value.isNull() | valid, value).otherwise(error)
