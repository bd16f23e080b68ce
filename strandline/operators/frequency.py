"""Per-key results without waiting for the few keys that hold most rows.

Rows are first compressed to the frequencies of their values, grouped by key and value
(partial on the map side, and spread over all tasks whatever the key). Distinct counts,
modes and percentiles are then exact results over weighted values. Percentiles need the
values of a key in order; they are found digit by digit, the highest first: of each key only the
counts per digit are ordered, and only values below the digits that hold a rank are counted again. A window
so has ``2 ** DIGIT_BITS`` rows at most, however many values a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16
_WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def value_frequencies(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``_key``, ``_value``, ``_n`` for the non-NULL values; a NULL key is a key of its own."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))


def distinct_and_mode(freq: DataFrame) -> DataFrame:
    """Per key: ``n``, ``distinct`` and ``mode`` (of equally frequent values the smallest)."""
    per_n = freq.groupBy("_key", "_n").agg(F.count(F.lit(1)).alias("_d"), F.min("_value").alias("_value"))
    return per_n.groupBy("_key").agg(F.sum(F.col("_n") * F.col("_d")).alias("n"), F.sum("_d").alias("distinct"), F.max_by("_value", "_n").alias("mode"))


def weighted_percentiles(freq: DataFrame, probabilities: Sequence[float], *, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Exact percentiles of integer values: ``_key``, ``probability``, ``value``.

    The value at probability p is the smallest one with at least ``ceil(p * n)`` rows (one at
    least) at or below it. Each digit of ``digit_bits`` bits costs one pass over the frequencies; their number
    follows from the type of the values.
    """
    width = _WIDTHS[freq.schema["_value"].dataType.simpleString()]
    shifts = list(range(0, width, digit_bits))[::-1]
    freq = freq.withColumn("_value", F.col("_value").cast("bigint"))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("_all")), F.lit(1)).alias("rank")) for p in probabilities])
    held: DataFrame | None = None  # per key and prefix the ranks in it, counted from the prefix's first row
    for shift in shifts:
        prefix = F.shiftright("_value", shift)
        if held is None:
            digits = freq.groupBy("_key", prefix.alias("_prefix")).agg(F.sum("_n").alias("_m"))
            digits = digits.withColumn("_all", F.sum("_m").over(Window.partitionBy("_key"))).withColumn("_ranks", ranks)
            part = Window.partitionBy("_key")
        else:
            inside = freq.join(held, F.col("_key").eqNullSafe(F.col("_hkey")) & (F.shiftright("_value", shift + digit_bits) == F.col("_hprefix")))
            digits = inside.groupBy("_key", "_hprefix", prefix.alias("_prefix")).agg(F.sum("_n").alias("_m"), F.any_value("_ranks").alias("_ranks"))
            part = Window.partitionBy("_key", "_hprefix")
        digits = digits.withColumn("_upto", F.sum("_m").over(part.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)))
        before = F.col("_upto") - F.col("_m")
        mine = F.filter("_ranks", lambda r: (r["rank"] > before) & (r["rank"] <= F.col("_upto")))
        mine = F.transform(mine, lambda r: F.struct(r["p"].alias("p"), (r["rank"] - before).alias("rank")))
        held = digits.select(F.col("_key").alias("_hkey"), F.col("_prefix").alias("_hprefix"), mine.alias("_ranks")).where(F.size("_ranks") > 0)
    return held.select(F.col("_hkey").alias("_key"), F.col("_hprefix").alias("value"), F.explode("_ranks").alias("r")).select("_key", F.col("r.p").alias("probability"), "value")


def key_profile(rows: DataFrame, key: str, values: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Long profile of integer columns per key: ``key``, ``field``, ``n``, ``distinct``, ``mode`` and ``percentiles``
    (array of ``probability``/``value`` in order). A key without a non-NULL value in a field has no row for it; a NULL
    key is a key of its own; empty rows give none; other columns are ignored."""
    out = None
    for v in values:
        freq = value_frequencies(rows, key, v)
        marks = weighted_percentiles(freq, probabilities).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("probability", "value"))).alias("percentiles"))
        part = distinct_and_mode(freq).join(marks.withColumnRenamed("_key", "_pkey"), F.col("_key").eqNullSafe(F.col("_pkey")))
        part = part.select(F.col("_key").alias("key"), F.lit(v).alias("field"), "n", "distinct", F.col("mode").cast("bigint").alias("mode"), "percentiles")
        out = part if out is None else out.unionByName(part)
    return out
