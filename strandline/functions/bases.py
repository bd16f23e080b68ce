"""Bases and quality scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes, and the order of the four-bit codes.
FORWARD = "ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn"
COMPLEMENT = "TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn"
FOUR_BIT = "=ACMGRSVTWYHKDBN"


def complement(seq: Column, *, strict: bool = False) -> Column:
    """Complement, case kept. Other characters pass; if ``strict`` they raise."""
    out = F.translate(seq, FORWARD, COMPLEMENT)
    if not strict:
        return out
    return F.when(seq.rlike(f"^[{FORWARD}]*\\z"), out).when(seq.isNotNull(), F.raise_error(F.lit("invalid base")).cast("string"))


def reverse_complement(seq: Column, *, strict: bool = False) -> Column:
    return F.reverse(complement(seq, strict=strict))


def normalised_md5(seq: Column) -> Column:
    """MD5 of the upper-case bases without characters outside ``!`` .. ``~``."""
    return F.md5(F.regexp_replace(F.upper(seq), "[^!-~]", ""))


def four_bit_text(seq: Column) -> Column:
    """The text after packing into four bits: upper case, unknown bases are ``N``."""
    return F.regexp_replace(F.upper(seq), r"[^=ACMGRSVTWYHKDBN]", "N")


def scores(quality: Column) -> Column:
    """Phred scores of a quality string (offset 33); NULL for ``*``, empty array for an empty text."""
    return F.when(quality == "", F.array().cast("array<int>")).when(quality != "*", F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33))


def quality_text(values: Column) -> Column:
    """The text of scores 0 .. 93; ``*`` for NULL or none."""
    joined = F.array_join(F.transform(values, lambda v: F.char(v + 33)), "")
    return F.when(values.isNull() | (F.size(values) == 0), "*").otherwise(joined)


def score_total(quality: Column) -> Column:
    return F.aggregate(scores(quality), F.lit(0).cast("bigint"), lambda a, v: a + v)


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Bases ``start`` .. ``end``; NULL where they exceed the sequence."""
    inside = (start >= 1) & (start <= end) & (end <= F.length(seq))
    return F.when(inside, F.substring(seq, start.cast("int"), (end - start + 1).cast("int")))


def clipped_subsequence(seq: Column, start: int | None, end: int | None) -> Column:
    """Bases of a region; an end beyond the sequence is clipped, a start beyond it gives an empty text."""
    lo = start or 1
    return F.substring(seq, lo, end - lo + 1) if end is not None else F.expr(f"substring({seq._jc.toString()}, {lo})")


def wrapped(seq: Column, width: int = 80) -> Column:
    """Text in lines of ``width`` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
