"""Pileup depth as runs of equal depth.

Match blocks of the CIGARs and whole spans are plus and minus events; their running sums are kept
per tile of the reference with a carry between tiles, as in ``sweep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cigar as cg
from strandline.functions import flags as fl


def match_blocks(cigar: Column) -> Column:
    """Array of ``at`` (offset on the reference) and ``len`` of the M, = and X operations."""
    init = F.struct(F.lit(0).cast("bigint").alias("off"), F.array().cast("array<struct<at:bigint,len:int>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        piled = o["op"].isin("M", "=", "X")
        moved = F.when(piled | o["op"].isin("D", "N"), o["len"]).otherwise(0)
        grown = F.when(piled, F.concat(acc["out"], F.array(F.struct(acc["off"].alias("at"), o["len"].alias("len"))))).otherwise(acc["out"])
        return F.struct((acc["off"] + moved).alias("off"), grown.alias("out"))

    # one operation, as most reads have, needs no loop
    single = F.regexp_extract(cigar, r"^(\d+)[M=X]\z", 1).try_cast("int")
    return F.when(single.isNotNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("at"), single.alias("len")))).otherwise(F.aggregate(cg.operations(cigar), init, step, lambda acc: acc["out"]))


def depth_runs(alignments: DataFrame, *, name: str, start: str, cigar: str, flags: str, zero_in_span: bool = True, tile_bits: int = 16) -> DataFrame:
    """Maximal runs between depth changes: ``name``, ``first_position``, ``last_position``, ``depth``.

    Unmapped, secondary, failed and duplicate records and records without a reference or start don't count.
    With ``zero_in_span`` positions inside deletions and skips of some read come out with depth 0; gaps
    between reads never do.
    """
    reads = alignments.where(F.col(name).isNotNull() & (F.col(start) >= 1) & fl.is_piled(F.col(flags))).select(F.col(name).alias("_n"), F.col(start).cast("bigint").alias("_s"), F.col(cigar).alias("_c"))
    # the reads themselves are not exchanged: their events are summed per position on the map side
    reads = reads.withColumn("_w", F.lit(1).cast("bigint"))
    span = cg.reference_span(F.col("_c"))
    change = lambda p, d, a: F.struct(p.alias("p"), d.alias("d"), a.alias("a"))
    no = F.lit(0).cast("bigint")
    blocks = F.flatten(F.transform(match_blocks(F.col("_c")), lambda b: F.array(change(F.col("_s") + b["at"], F.col("_w"), no), change(F.col("_s") + b["at"] + b["len"], -F.col("_w"), no))))
    ends = F.array(change(F.col("_s"), no, F.col("_w")), change(F.col("_s") + span, no, -F.col("_w")))
    events = (
        reads.where(span.isNotNull())
        .select("_n", F.inline(F.concat(blocks, ends)))
        .groupBy("_n", F.shiftright("p", tile_bits).alias("_t"), F.col("p").alias("_p"))
        .agg(F.sum("d").alias("_d"), F.sum("a").alias("_a"))
        .where((F.col("_d") != 0) | (F.col("_a") != 0))
    )
    tiles = events.groupBy("_n", "_t").agg(F.sum("_d").alias("_d"), F.sum("_a").alias("_a"), F.min("_p").alias("_first"))
    by_name = Window.partitionBy("_n").orderBy("_t")
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    # two rows a tile: what is open where it begins, and where the next tile's first event is
    line = lambda o, p, d, a: F.struct(F.lit(o).alias("_o"), p.alias("_p"), d.alias("_d"), a.alias("_a"))
    open_ = [F.coalesce(F.sum(c).over(before), no) for c in ("_d", "_a")]
    edges = tiles.select("_n", "_t", *[c.alias(f"_w{i}") for i, c in enumerate((*open_, F.lead("_first").over(by_name)))])
    edges = edges.select("_n", "_t", F.inline(F.array(line(0, F.lit(None).cast("bigint"), F.col("_w0"), F.col("_w1")), line(2, F.col("_w2"), no, no)))).where((F.col("_o") == 0) | F.col("_p").isNotNull())
    lines = events.select("_n", "_t", F.lit(1).alias("_o"), "_p", "_d", "_a").unionByName(edges)
    order = Window.partitionBy("_n", "_t").orderBy("_o", "_p")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.select("_n", "_o", "_p", F.sum("_d").over(upto).alias("depth"), F.sum("_a").over(upto).alias("_open"), F.lead("_p").over(order).alias("_next")).where(F.col("_o") == 1)
    wanted = (F.col("_open") > 0) if zero_in_span else (F.col("depth") > 0)
    return runs.where(wanted).select(F.col("_n").alias(name), F.col("_p").alias("first_position"), (F.col("_next") - 1).alias("last_position"), "depth")


def per_position(runs: DataFrame, *, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Runs expanded to positions, within ``lo`` .. ``hi`` if given (cut before the expansion)."""
    first = F.col("first_position") if lo is None else F.greatest("first_position", F.lit(lo))
    last = F.col("last_position") if hi is None else F.least("last_position", F.lit(hi))
    keep = [c for c in runs.columns if c not in ("first_position", "last_position", "depth")]
    return runs.where(first <= last).select(*keep, F.explode(F.sequence(first, last)).alias("position"), "depth")
