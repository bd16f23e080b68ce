"""Event-time windows, the same plan for batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import cigar as cg
from strandline.functions import flags as fl


def windowed_counts(events: DataFrame, *, time: str, key: str, value: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum per window and key, a new window every ``slide`` (tumbling, if not given); ``late`` sets a watermark, needed for append output of streams."""
    if late is not None:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, width, slide).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("_w.start").alias("event_window"), key, "n", "total")


def streamed_depth(alignments: DataFrame, *, name: str, start: str, cigar: str, flags: str) -> DataFrame:
    """Depth per position of a stream of alignments, in any order: ``name``, ``position``, ``depth``.

    The state is one count per covered position, kept by name and position, so no reference is in one task; positions
    inside deletions and skips come out with depth 0. For output modes ``update`` and ``complete``.
    """
    reads = alignments.where(F.col(name).isNotNull() & (F.col(start) >= 1) & fl.is_piled(F.col(flags))).select(F.col(name).alias("_n"), F.col(start).cast("bigint").alias("_s"), cg.operations(F.col(cigar)).alias("_o"))
    covers = lambda o: F.when(o["op"].isin(*cg.CONSUMES_REFERENCE), o["len"]).otherwise(0)
    before = F.transform("_o", lambda o, i: F.aggregate(F.slice("_o", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + covers(x)))
    spans = F.zip_with("_o", before, lambda o, b: F.struct(b.alias("at"), covers(o).alias("len"), o["op"].isin("M", "=", "X").alias("read")))
    blocks = reads.select("_n", "_s", F.inline(F.filter(spans, lambda x: x["len"] > 0)))
    positions = blocks.select(F.col("_n").alias(name), F.explode(F.sequence(F.col("_s") + F.col("at"), F.col("_s") + F.col("at") + F.col("len") - 1)).alias("position"), F.col("read").cast("int").alias("_read"))
    return positions.groupBy(name, "position").agg(F.sum("_read").alias("depth"))
