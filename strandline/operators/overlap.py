"""Overlap joins of intervals on tiles, and region filters.

The positions are cut into tiles. An interval is cut at the finest of several tile sizes at which it touches no more
than ``MOST_TILES`` of them, so that ordinary intervals lie in one or two small tiles and long ones in a bounded number of large
ones. Two intervals meet at the larger of their two sizes: besides its own tiles a row is given those of the larger
sizes that the other side really uses (a handful, looked up first). The join is one equi-join on name, size
and tile; a pair is kept in the first tile that both touch. No key holds more than the rows of one tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import bins
from strandline.functions.regions import Region


def region_filter(rows: DataFrame, region: Region, *, name: str, start: Column, end: Column) -> DataFrame:
    """Rows overlapping a region; an unbounded region takes all rows of its reference."""
    return rows.where(region.overlaps(F.col(name), start, end))


#: Tiles of an interval at most, and the bits by which one tile size exceeds the one before.
MOST_TILES, STEP = 64, 3


def _size_no(start: Column, end: Column, tile_bits: int) -> Column:
    """Number of the finest tile size at which the interval touches no more than ``MOST_TILES`` tiles."""
    number = None
    for n, bits in enumerate(range(tile_bits, 63, STEP)):
        few = F.shiftright(end - 1, bits) - F.shiftright(start - 1, bits) < MOST_TILES
        number = F.when(few, n) if number is None else number.when(few, n)
    return number.otherwise(n + 1)


def _touched(start: Column, end: Column, number: Column, tile_bits: int, own: bool) -> Column:
    bits = F.least(number * STEP + tile_bits, F.lit(63))
    tile = lambda x: F.call_function("shiftright", x - 1, bits)
    return F.transform(F.sequence(tile(start), tile(end)), lambda t: F.struct(number.cast("int").alias("n"), t.alias("t"), F.lit(own).alias("own")))


def overlap_join(
    left: DataFrame, right: DataFrame, *, left_on: tuple[str, str, str], right_on: tuple[str, str, str], tile_bits: int = bins.MIN_SHIFT, left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None
) -> DataFrame:
    """Pairs of rows with equal names and a shared position: ``left`` (struct) and ``right`` (struct).

    ``left_on``/``right_on``: columns of name, start and end. Rows with a NULL name or bound, a start below 1 or an end
    below the start match nothing. Positions may be any 64-bit integers. Repeated rows give repeated pairs; an empty side gives no rows.
    """

    def side(df: DataFrame, on: tuple[str, str, str], columns: Sequence[str] | None, tag: str) -> DataFrame:
        n, s, e = (F.col(c) for c in on)
        valid = df.where(n.isNotNull() & (s >= 1) & (e >= s))
        s, e = s.cast("bigint"), e.cast("bigint")
        return valid.select(n.alias(f"_name{tag}"), s.alias(f"_s{tag}"), e.alias(f"_e{tag}"), _size_no(s, e, tile_bits).alias(f"_z{tag}"), F.struct(*(columns or df.columns)).alias(tag))

    def sizes(df: DataFrame, tag: str) -> list[int]:
        return sorted(df.agg(F.collect_set(f"_z{tag}")).first()[0])

    def tiled(df: DataFrame, tag: str, others: list[int]) -> DataFrame:
        s, e, z = F.col(f"_s{tag}"), F.col(f"_e{tag}"), F.col(f"_z{tag}")
        own = _touched(s, e, z, tile_bits, True)
        lifted = [F.when(z < n, _touched(s, e, F.lit(n), tile_bits, False)).otherwise(F.slice(own, 1, 0)) for n in others if n > 0]
        return df.select(f"_name{tag}", f"_s{tag}", f"_e{tag}", tag, F.inline(F.concat(own, *lifted)).alias(f"_n{tag}", f"_t{tag}", f"_own{tag}"))

    a, b = side(left, left_on, left_columns, "left"), side(right, right_on, right_columns, "right")
    a, b = tiled(a, "left", sizes(b, "right")), tiled(b, "right", sizes(a, "left"))
    later = F.greatest("_sleft", "_sright") - 1
    first = F.col("_tleft") == F.call_function("shiftright", later, F.least(F.col("_nleft") * STEP + tile_bits, F.lit(63)))
    meet = (F.col("_nameleft") == F.col("_nameright")) & (F.col("_nleft") == F.col("_nright")) & (F.col("_tleft") == F.col("_tright"))
    kept = (F.col("_ownleft") | F.col("_ownright")) & (F.col("_sleft") <= F.col("_eright")) & (F.col("_sright") <= F.col("_eleft")) & first
    return a.join(b, meet & kept).select("left", "right")
