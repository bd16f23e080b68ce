"""Statistics of alignments: flag counts, counts per reference, and the aggregates of an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import bins
from strandline.functions import cigar as cg
from strandline.functions.flags import has, is_primary
from strandline.operators.sweep import covered_and_gaps

#: Least mapping quality that counts as high in flag statistics: a fixed value.
HIGH_QUALITY = 5


def _flag_conditions(flags: Column, ref: Column, mate_ref: Column, mapq: Column) -> dict[str, Column]:
    f = lambda n: has(flags, n)
    primary, mapped, duplicate = is_primary(flags), ~f("is_unmapped"), f("is_duplicate")
    paired = primary & f("is_segmented")
    both = paired & mapped & ~f("is_mate_unmapped")
    apart = both & ~ref.eqNullSafe(mate_ref)
    return {
        "read": F.lit(True),
        "mapped": mapped,
        "duplicate": duplicate,
        "secondary": f("is_secondary"),
        "supplementary": ~f("is_secondary") & f("is_supplementary"),
        "primary": primary,
        "primary_mapped": primary & mapped,
        "primary_duplicate": primary & duplicate,
        "paired": paired,
        "read_1": paired & f("is_first_segment"),
        "read_2": paired & f("is_last_segment"),
        "proper_pair": paired & mapped & f("is_properly_segmented"),
        "singleton": paired & mapped & f("is_mate_unmapped"),
        "mate_mapped": both,
        "mate_reference_mismatch": apart,
        "mate_reference_mismatch_hq": apart & (mapq.isNull() | (mapq >= HIGH_QUALITY)),
    }


def flagstat(alignments: DataFrame, *, flags: str, reference: Column, mate_reference: Column, mapping_quality: Column) -> DataFrame:
    """Sixteen counters for records that passed quality control and for those that failed: at most two rows, ``qc_fail`` first.

    Records with NULL flags are left out. One scan, one partial aggregation.
    """
    conditions = _flag_conditions(F.col("_f"), F.col("_r"), F.col("_m"), F.col("_q"))
    staged = alignments.where(F.col(flags).isNotNull()).select(F.col(flags).alias("_f"), reference.alias("_r"), mate_reference.alias("_m"), mapping_quality.alias("_q"))
    return staged.groupBy(has(F.col("_f"), "is_qc_fail").alias("qc_fail")).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def percent(a: Column, b: Column) -> Column:
    """``12.34%``, or ``N/A`` for a share of nothing."""
    return F.when(b == 0, "N/A").otherwise(F.format_string("%.2f%%", a * 100.0 / b))


def idxstats(alignments: DataFrame, dictionary: DataFrame, *, reference: str, flags: str, key: str, name: str, length: str) -> DataFrame:
    """Mapped and unmapped placed records of every reference of the dictionary, and a ``*`` row for unplaced ones.

    A record is unplaced if its reference is NULL or negative. Records of references that the dictionary lacks are
    not counted. ``dictionary`` has one row per reference; its size decides how it is joined.
    """
    unmapped = has(F.col(flags), "is_unmapped")
    placed = F.when(F.col(reference) >= 0, F.col(reference))
    counts = alignments.groupBy(placed.alias("_r")).agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"), F.count(F.lit(1)).alias("_all"))
    known = dictionary.select(F.col(key).alias("_k"), F.col(name).alias("name"), F.col(length).cast("bigint").alias("length"))
    per = known.join(counts, F.col("_k") == F.col("_r"), "left").select("name", "length", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))
    rest = counts.where(F.col("_r").isNull()).select(F.lit("*").alias("name"), F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("mapped"), F.col("_all").alias("unmapped"))
    return per.unionByName(rest)


def binned(alignments: DataFrame, *, reference: str, start: str, cigar: str, offset: str, min_shift: int = bins.MIN_SHIFT, depth: int = bins.DEPTH) -> DataFrame:
    """Placed records with their reference ``ref``, ``bin``, ``start``, ``end`` and ``offset``."""
    end = cg.alignment_end(F.col(start), F.col(cigar))
    return alignments.where((F.col(reference) >= 0) & (F.col(start) >= 1)).select(
        F.col(reference).alias("ref"), bins.reg2bin(F.col(start), end, min_shift, depth).alias("bin"), F.col(start).alias("start"), end.alias("end"), F.col(offset).alias("offset"), *[c for c in alignments.columns if c not in ("ref", "bin", "start", "end", "offset")]
    )


def index_chunks(records: DataFrame, keys: Sequence[str] = ("ref", "bin")) -> DataFrame:
    """Per key the chunks of consecutive offsets: ``chunk_start`` and ``chunk_end`` (one beyond the last offset)."""
    runs = covered_and_gaps(records, keys, "offset", "offset", gaps=False)
    return runs.select(*keys, F.col("first_position").alias("chunk_start"), (F.col("last_position") + 1).alias("chunk_end"))


def merged_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks (``chunk_start`` up to, not including, ``chunk_end``) with overlapping and touching ones joined."""
    spans = chunks.where(F.col("chunk_end") > F.col("chunk_start")).withColumn("_last", F.col("chunk_end") - 1)
    runs = covered_and_gaps(spans, keys, "chunk_start", "_last", gaps=False)
    return runs.select(*keys, F.col("first_position").alias("chunk_start"), (F.col("last_position") + 1).alias("chunk_end"))


def linear_windows(records: DataFrame, min_shift: int = bins.MIN_SHIFT) -> DataFrame:
    """Least offset of the records that overlap each window: ``ref``, ``window``, ``min_offset``."""
    windows = F.sequence(F.shiftright(F.col("start") - 1, min_shift), F.shiftright(F.col("end") - 1, min_shift))
    return records.select("ref", F.explode(windows).alias("window"), "offset").groupBy("ref", "window").agg(F.min("offset").alias("min_offset"))


def index_metadata(alignments: DataFrame, *, reference: str, flags: str, offset: str) -> DataFrame:
    """Per reference the first offset, one beyond the last, and the counts of mapped and unmapped records."""
    unmapped = has(F.col(flags), "is_unmapped")
    return (
        alignments.where(F.col(reference) >= 0)
        .groupBy(F.col(reference).alias("ref"))
        .agg(F.min(offset).alias("first_offset"), (F.max(offset) + 1).alias("end_offset"), F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    )


def slice_index(alignments: DataFrame, *, slice_: Column, reference: str, start: str, cigar: str) -> DataFrame:
    """Per slice and reference the first position and the span, as an index of containers holds them."""
    end = cg.alignment_end(F.col(start), F.col(cigar))
    per = alignments.where(F.col(reference) >= 0).groupBy(slice_.alias("slice"), F.col(reference).alias("ref")).agg(F.min(start).alias("start"), F.max(end).alias("_end"), F.count(F.lit(1)).alias("records"))
    return per.select("slice", "ref", "start", (F.col("_end") - F.col("start") + 1).alias("span"), "records")


def fai(lines: DataFrame, *, name: str, number: str, offset: str, line: str) -> DataFrame:
    """A sequence index from the base lines of sequences: ``name``, ``length``, ``position``, ``line_bases``, ``line_width``.

    ``lines`` has every line of bases with its sequence's name, number (from 0), byte offset and text without its
    line end; widths count one line-feed byte. A sequence with lines of unequal length before the last, or a longer
    last line, raises.
    """
    size = F.length(line).cast("bigint")
    per = lines.groupBy(F.col(name).alias("name")).agg(
        F.sum(size).alias("length"), F.min(offset).alias("position"), F.max_by(size, -F.col(number)).alias("line_bases"), F.max(size).alias("_max"), F.count(F.lit(1)).alias("_n"), F.max_by(size, F.col(number)).alias("_last")
    )
    even = (F.col("_max") == F.col("line_bases")) & (F.col("length") == (F.col("_n") - 1) * F.col("line_bases") + F.col("_last"))
    checked = F.when(even, F.col("line_bases")).otherwise(F.raise_error(F.concat(F.lit("uneven lines in "), F.col("name"))).cast("bigint"))
    return per.select("name", "length", "position", checked.alias("line_bases"), (F.col("line_bases") + 1).alias("line_width"))


def first_appearance(rows: DataFrame, name: str, offset: str) -> DataFrame:
    """Distinct names with their first offset."""
    return rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(offset).alias("first_offset"))


def substitutions(pairs: DataFrame, reference_base: str, read_base: str) -> DataFrame:
    """How often each read base stands for each other reference base."""
    r, b = F.upper(reference_base), F.upper(read_base)
    return pairs.where(r != b).groupBy(r.alias("reference_base"), b.alias("read_base")).agg(F.count(F.lit(1)).alias("n"))


def unsorted_records(rows: DataFrame, *, file: str, offset: str, reference: str, start: str, tile: int = 1 << 20) -> DataFrame:
    """Per file the number of records that come before their predecessor: ``file``, ``unsorted``.

    Order is by ``reference`` (a number; missing or negative ones come last) and ``start``. Records are compared inside
    tiles of ``tile`` offsets, whose last and first records are compared with each other, so no file is in one task.
    """
    place = F.struct(F.when(F.col(reference) >= 0, F.col(reference).cast("bigint")).otherwise(2**40).alias("r"), F.coalesce(F.col(start).cast("bigint"), F.lit(0)).alias("s"))
    spots = rows.select(F.col(file).alias("_f"), F.col(offset).cast("bigint").alias("_o"), place.alias("_p")).withColumn("_t", F.floor(F.col("_o") / tile))
    by = Window.partitionBy("_f", "_t").orderBy("_o")
    inside = spots.withColumn("_bad", (F.col("_p") < F.lag("_p").over(by)).cast("int")).groupBy("_f", "_t")
    tiles = inside.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("_n"), F.min_by("_p", "_o").alias("_first"), F.max_by("_p", "_o").alias("_last"))
    between = F.when(F.col("_first") < F.lag("_last").over(Window.partitionBy("_f").orderBy("_t")), 1).otherwise(0)
    return tiles.withColumn("_n", F.col("_n") + between).groupBy(F.col("_f").alias("file")).agg(F.sum("_n").alias("unsorted"))


def tag_sets(tags: DataFrame, *, record: str, tag: str) -> DataFrame:
    """How many records have each set of tags: ``tag_set`` (distinct tags in order, joined by commas) and ``records``.

    Rows with a NULL record or tag are left out; repeated rows of a record change nothing.
    """
    pairs = tags.where(F.col(record).isNotNull() & F.col(tag).isNotNull()).select(F.col(record).alias("_r"), F.col(tag).alias("_t")).distinct()
    per = pairs.groupBy("_r").agg(F.array_join(F.array_sort(F.collect_list("_t")), ",").alias("tag_set"))
    return per.groupBy("tag_set").agg(F.count(F.lit(1)).alias("records"))
