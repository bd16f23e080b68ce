"""References to records that did not exist: binary search in sorted parent arrays.

A parent row is valid from ``added`` up to but not including ``removed`` (NULL: no end).
The lifetimes of a key are first merged into disjoint periods. Periods and references of all fields are
then range-partitioned together by field and key and sorted, so that a task meets the periods of a range
of keys before their references: it keeps them as sorted arrays and probes Arrow batches of references
by binary search for (key, time). The most frequent keys are divided by a salt in proportion to their
references, and only their periods are repeated per salt.

``probe_held`` is the way without a shuffle, for a caller who knows that the parents fit into every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.sweep import covered_and_gaps

RANGE_ROWS = 65_536
FOREVER = 2**63 - 2


def lifetimes(parents: DataFrame, key: str, added: str, removed: str) -> DataFrame:
    """Disjoint validity periods ``k``, ``a``, ``z`` (microseconds, both included) of every parent key."""
    spans = parents.where(F.col(key).isNotNull() & F.col(added).isNotNull()).select(
        F.col(key).cast("bigint").alias("k"),
        F.unix_micros(F.col(added).cast("timestamp")).alias("a"),
        F.coalesce(F.unix_micros(F.col(removed).cast("timestamp")) - 1, F.lit(FOREVER)).alias("z"),
    )
    merged = covered_and_gaps(spans, ["k"], "a", "z", gaps=False, tile_bits=44)
    return merged.select("k", F.col("first_position").alias("a"), F.col("last_position").alias("z"))


class SortedParents:
    """Periods sorted by (key, start), in arrays of at most ``RANGE_ROWS`` rows per range of keys."""

    def __init__(self, k: np.ndarray, a: np.ndarray, z: np.ndarray) -> None:
        order = np.lexsort((a, k))
        k, a, z = k[order], a[order], z[order]
        cuts = [0]
        while cuts[-1] < len(k):  # a key is never divided between two ranges
            at = min(cuts[-1] + RANGE_ROWS, len(k))
            cuts.append(int(np.searchsorted(k, k[at - 1], "right")))
        self.ranges = [(k[i:j], a[i:j], z[i:j]) for i, j in zip(cuts, cuts[1:])]
        self.firsts = np.array([r[0][0] for r in self.ranges], dtype=np.int64)

    def missing(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per reference whether no period of its key holds its time."""
        out = np.ones(len(key), dtype=bool)
        of = np.searchsorted(self.firsts, key, "right") - 1
        for r in np.unique(of[of >= 0]):
            k, a, z = self.ranges[r]
            here = np.flatnonzero(of == r)
            x, t = key[here], at[here]
            lo, hi = np.searchsorted(k, x, "left"), np.searchsorted(k, x, "right")
            first = lo.copy()
            while (open_ := lo < hi).any():  # the last period that starts at or before t
                mid = (lo + hi) >> 1
                right = open_ & (a[np.minimum(mid, len(a) - 1)] <= t)
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            found = lo > first
            out[here] = ~(found & (z[np.maximum(lo - 1, 0)] >= t))
        return out


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(n).fill_null(0).cast(pa.int64())) for n in names]


def _times(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _hot_keys(refs: DataFrame, n: int) -> DataFrame:
    """The ``4 * n`` most frequent (field, key) with their numbers of salts, at most ``5 * n`` together.

    Any other key has at most a ``4 * n``-th of the references, less than a partition's share.
    """
    top = refs.groupBy("f", "k").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "f", "k").limit(4 * n).collect()
    fair = max(1, sum(r["c"] for r in top) // n)
    rows = [(r["f"], r["k"], -(-r["c"] // fair)) for r in top if r["c"] > fair]
    return refs.sparkSession.createDataFrame(rows, "f int, k bigint, n int")


def orphan_references(references: DataFrame, parents: dict[str, tuple[DataFrame, str]], *, record_id: str, at: str, keep: Sequence[str] = (), added: str = "added_at", removed: str = "removed_at") -> DataFrame:
    """The references for which no parent row was valid at the time ``at``, of all given fields together.

    ``parents``: per reference field its parent table and the key column there. Output: ``keep`` (columns of
    text), ``record_id``, ``field_name``, ``key`` and ``at``, one row per orphan. A reference is a value that is neither NULL
    nor negative; with a NULL time no parent is valid, so it is an orphan. Parents with a NULL key or NULL
    ``added`` are never valid. Records are reported as often as they occur; an empty parent table makes every
    reference an orphan; empty references give no rows. Other columns are ignored, whatever their names.
    """
    spark = references.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(parents)
    kept = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(keep)]
    cs = [f"c{i}" for i in range(len(kept))]
    given = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("bigint").alias("k")) for i, f in enumerate(names)])
    refs = references.select(F.col(record_id).cast("bigint").alias("id"), _times(at).alias("t"), *kept, F.inline(given)).where(F.col("k") >= 0)
    periods = None
    for i, (table, key) in enumerate(parents.values()):
        own = lifetimes(table, key, added, removed).select(F.lit(i).alias("f"), "k", "a", "z")
        periods = own if periods is None else periods.unionByName(own)
    hot = F.broadcast(_hot_keys(refs, n))
    none = F.lit(None).cast("bigint")
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("id", "t"), F.col("n"))).otherwise(0).cast("int")
    salted = refs.join(hot, ["f", "k"], "left").select("f", "k", salt.alias("s"), F.lit(1).alias("side"), "t", "id", none.alias("z"), *cs)
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
    repeated = periods.join(hot, ["f", "k"], "left").select("f", "k", salts.alias("s"), F.lit(0).alias("side"), F.col("a").alias("t"), none.alias("id"), "z", *[F.lit(None).cast("string").alias(c) for c in cs])
    together = repeated.unionByName(salted).repartitionByRange(n, "f", "k", "s").sortWithinPartitions("f", "k", "s", "side", "t")
    schema = "id bigint, f int, k bigint, t bigint" + "".join(f", {c} string" for c in cs)
    found = together.mapInArrow(_stream, schema)
    field = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("f") + 1)
    return found.select(*[F.col(c).alias(k) for c, k in zip(cs, keep)], F.col("id").alias("record_id"), field.alias("field_name"), F.col("k").alias("key"), F.timestamp_micros("t").alias("at"))


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probe sorted rows: the periods (side 0) of a field, key and salt come before its references (side 1)."""
    held, of = [np.empty(0, np.int64)] * 3, None
    for b in batches:
        if not b.num_rows:
            continue
        field, side, k, t, z = _arrays(b, "f", "side", "k", "t", "z")
        timeless = np.asarray(b.column("t").is_null())
        cuts = [0, *(np.flatnonzero(np.diff(field)) + 1), len(field)]
        for lo, hi in zip(cuts, cuts[1:]):  # one field at a time
            if of != field[lo]:
                held, of = [np.empty(0, np.int64)] * 3, field[lo]
            own = lo + np.flatnonzero(side[lo:hi] == 0)
            held = [np.concatenate((h, x[own])) for h, x in zip(held, (k, t, z))]
            refs = lo + np.flatnonzero(side[lo:hi] == 1)
            if len(refs):
                miss = refs[SortedParents(*held).missing(k[refs], t[refs]) | timeless[refs]]
                names = [c for c in b.schema.names if c not in ("s", "side", "z", "id", "f", "k", "t")]
                yield b.select(["id", "f", "k", "t", *names]).take(pa.array(miss))
            last = held[0] == k[hi - 1]
            held = [h[last] for h in held]  # only the periods of the last key can be needed again


def probe_held(references: DataFrame, periods: DataFrame, field: str, *, record_id: str, at: str, max_rows: int) -> DataFrame:
    """As ``orphan_references`` for one field, with the ``lifetimes`` of its parents in every task and no shuffle.

    Raises if there are more than ``max_rows`` periods (24 bytes each, in every Python worker).
    """
    got = periods.limit(max_rows + 1).toArrow()
    if got.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} periods of parents")
    shared = references.sparkSession.sparkContext.broadcast(SortedParents(*[np.asarray(got.column(c)) for c in ("k", "a", "z")]))
    refs = references.where(F.col(field) >= 0).select(F.col(record_id).cast("bigint").alias("id"), F.col(field).cast("bigint").alias("k"), _times(at).alias("t"))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t = _arrays(b, "k", "t")
            yield b.take(pa.array(np.flatnonzero(shared.value.missing(k, t) | np.asarray(b.column("t").is_null()))))

    found = refs.mapInArrow(probe, "id bigint, k bigint, t bigint")
    return found.select(F.col("id").alias("record_id"), F.lit(field).alias("field_name"), F.col("k").alias("key"), F.timestamp_micros("t").alias("at"))


def orphan_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Orphans per ``keys`` and month of ``at`` (first day as text, NULL for a NULL time)."""
    return found.groupBy(*keys, F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
