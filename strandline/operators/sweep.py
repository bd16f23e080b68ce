"""Covered periods and gaps of intervals, by a sweep line over plus and minus events.

The line is cut into tiles so that no group, however large, has to pass through one
task: events are summed per position on the map side, running counts are kept inside a
tile, and only one row per group and tile takes part in the carry from tile to tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST = 2**63 - 1


def _transitions(intervals: DataFrame, keys: list[str], start: str, end: str, tile_bits: int) -> DataFrame:
    """Positions at which the number of open intervals leaves or reaches zero.

    Columns: the keys, ``_t`` (tile), ``_p`` (position) and ``_up`` (true: coverage begins at
    ``_p``; false: ``_p`` is the first uncovered position).
    """
    valid = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).cast("bigint").alias("_a"), F.col(end).cast("bigint").alias("_z")
    )
    ks = [f"_k{i}" for i in range(len(keys))]
    # an end at the very last position has no minus event: it never closes
    both = F.array(F.struct(F.col("_a").alias("p"), F.lit(1).alias("d")), F.struct(F.try_add("_z", F.lit(1)).alias("p"), F.lit(-1).alias("d")))
    events = (
        valid.select(*ks, F.inline(both))
        .where(F.col("p").isNotNull())
        .select(*ks, F.shiftright("p", tile_bits).alias("_t"), F.col("p").alias("_p"), "d")
        .groupBy(*ks, "_t", "_p")
        .agg(F.sum("d").alias("_d"))
    )
    carried = (
        events.groupBy(*ks, "_t")
        .agg(F.sum("_d").alias("_d"))
        .withColumn("_open", F.sum("_d").over(Window.partitionBy(*ks).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("_open") > 0)
        .select(*ks, "_t", F.lit(None).cast("bigint").alias("_p"), F.col("_open").alias("_d"))
    )
    w = Window.partitionBy(*ks, "_t").orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = events.where(F.col("_d") != 0).unionByName(carried).withColumn("_now", F.sum("_d").over(w))
    up = F.col("_now") == F.col("_d")  # nothing was open before
    return run.where(F.col("_p").isNotNull() & (up | (F.col("_now") == 0))).select(*ks, "_t", "_p", up.alias("_up"))


def covered_and_gaps(intervals: DataFrame, keys: Sequence[str], start: str, end: str, *, gaps: bool = True, tile_bits: int = 16) -> DataFrame:
    """Periods and gaps of the closed intervals ``start``..``end`` of every group of ``keys``.

    Output: the keys, ``kind`` (``period`` or ``gap``), ``first_position``, ``last_position``, both
    ends included. A period is a maximal run of covered positions (intervals that follow on
    directly join); a gap lies between two successive periods. Rows with a NULL bound or an end
    before the start are no intervals; repeated and nested rows change nothing; NULL keys form a
    group of their own; an empty input gives no rows. Other columns are ignored, whatever their
    names. A tile holds ``2 ** tile_bits`` positions, which bounds the rows of one window; a group
    has at most its range of positions divided by that many rows in the carry.
    """
    keys = list(keys)
    ks = [f"_k{i}" for i in range(len(keys))]
    turns = _transitions(intervals, keys, start, end, tile_bits)
    first = (
        turns.groupBy(*ks, "_t")
        .agg(F.min("_p").alias("_first"))
        .withColumn("_p", F.lead("_first").over(Window.partitionBy(*ks).orderBy("_t")))
        .where(F.col("_p").isNotNull())
        .select(*ks, "_t", "_p", F.lit(None).cast("boolean").alias("_up"))
    )
    following = F.lead("_p").over(Window.partitionBy(*ks, "_t").orderBy("_p"))
    spans = turns.unionByName(first).withColumn("_next", following).where(F.col("_up").isNotNull())
    if not gaps:
        spans = spans.where("_up")
    return spans.where(F.col("_up") | F.col("_next").isNotNull()).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.when(F.col("_up"), "period").otherwise("gap").alias("kind"),
        F.col("_p").alias("first_position"),
        F.coalesce(F.col("_next") - 1, F.lit(LAST)).alias("last_position"),
    )
