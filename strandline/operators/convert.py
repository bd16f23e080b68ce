"""Conversions between kinds of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.bases import reverse_complement
from strandline.functions.flags import BITS, has, is_primary


def to_reads(alignments: DataFrame, *, name: str, flags: str, seq: str, quality: str) -> DataFrame:
    """Unpaired primary alignments as reads: ``name``, ``sequence``, ``quality`` in the direction of sequencing.

    Secondary and supplementary records are left out; a paired record raises, as its mate would be lost.
    """
    f = F.col(flags)
    reverse = has(f, "is_reverse_complemented")
    paired = F.when(has(f, "is_segmented"), F.raise_error(F.lit("paired records can't be exported as single reads")).cast("string"))
    return alignments.where(is_primary(f)).select(
        F.coalesce(paired, F.col(name)).alias("name"),
        F.when(reverse, reverse_complement(F.col(seq))).otherwise(F.col(seq)).alias("sequence"),
        F.when(reverse, F.reverse(F.col(quality))).otherwise(F.col(quality)).alias("quality"),
    )


def reset_flags(flags: Column) -> Column:
    """Flags of a record without alignment: pairing and order of segments stay, it and its mate are unmapped."""
    kept = flags.bitwiseAND(BITS["is_segmented"] | BITS["is_first_segment"] | BITS["is_last_segment"] | BITS["is_qc_fail"])
    unmapped = kept.bitwiseOR(F.lit(BITS["is_unmapped"]))
    return F.when(has(flags, "is_segmented"), unmapped.bitwiseOR(F.lit(BITS["is_mate_unmapped"]))).otherwise(unmapped)


def reset(alignments: DataFrame, *, flags: str, seq: str, quality: str) -> DataFrame:
    """Primary records without their alignment: ``flags``, ``seq`` and ``quality`` replaced, the other columns kept."""
    f = F.col(flags)
    reverse = has(f, "is_reverse_complemented")
    new = {
        flags: reset_flags(f),
        seq: F.when(reverse, reverse_complement(F.col(seq))).otherwise(F.col(seq)),
        quality: F.when(reverse, F.reverse(F.col(quality))).otherwise(F.col(quality)),
    }
    return alignments.where(is_primary(f)).withColumns(new)


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column, is_first: Column) -> Column:
    """Signed length of a template: positive for the leftmost segment, of equal starts for the first one."""
    size = F.greatest(end, mate_end) - F.least(start, mate_start) + 1
    left = (start < mate_start) | ((start == mate_start) & is_first)
    return F.when(left, size).otherwise(-size)


def mates(alignments: DataFrame, *, name: str, flags: str, columns: list[str]) -> DataFrame:
    """First and last segments of the same primary template: ``name``, ``first`` and ``last`` (structs of ``columns``)."""
    f = F.col(flags)
    primary = alignments.where(is_primary(f) & has(f, "is_segmented"))
    side = lambda bit, other, tag: primary.where(has(f, bit) & ~has(f, other)).select(F.col(name).alias(f"_{tag}"), F.struct(*columns).alias(tag))
    first, last = side("is_first_segment", "is_last_segment", "first"), side("is_last_segment", "is_first_segment", "last")
    return first.join(last, F.col("_first") == F.col("_last")).select(F.col("_first").alias("name"), "first", "last")


def split_by_group(alignments: DataFrame, groups: DataFrame, *, group: str, key: str, label: str) -> DataFrame:
    """Records with the label of their read group, ready for ``write.partitionBy``; those without a group are dropped, an unknown group raises."""
    known = groups.select(F.col(key).alias("_k"), F.col(label).alias("_label")).distinct()
    joined = alignments.where(F.col(group).isNotNull()).join(known, F.col(group) == F.col("_k"), "left")
    missing = F.raise_error(F.concat(F.lit("unknown read group "), F.col(group).cast("string"))).cast("string")
    return joined.withColumn("_label", F.coalesce("_label", missing)).drop("_k").withColumnRenamed("_label", label if label not in alignments.columns else f"group_{label}")
