"""Percentiles with bounded error from mergeable dyadic count-sketches.

A value is encoded as an unsigned code of ``BITS`` bits whose order is that of the values. Level ``l`` of a
sketch counts the codes shifted right by ``l`` bits, in a count-sketch of ``DEPTH`` rows of counters with random
signs; from ``EXACT_BITS`` bits up the nodes of a level are counted themselves, of which only the lowest such
level is kept, as its sums are the others. A sketch is an array of counters, so merging is addition, sketches of files or days can be
stored and added later, and a deletion is an insertion of weight -1. A rank is inverted by
descending the levels: left if it lies within the estimate of the left child, else right.

Every task adds its rows to sketches of its own (in numpy, at most ``BUFFER_ROWS`` rows at a time, whatever
the number of groups) and hands on only these; sketches of a group are added up as they stream by in order of groups.
Nothing is counted per value before.

The error is measured, not assumed: nodes beyond the codes never occur, so what a sketched level estimates for
them is its noise. ``rank_error`` is what the sums of such noise along ``PATHS`` random paths through the
levels exceed in no more than one of two thousand, as a share of the group's rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA = 10
"""Bits kept below the leading bit: values below 2 ** 11 in size are exact, others within 1 in 2 ** 11."""
BITS = 17
"""A sign and 2 ** 16 codes of sizes, which hold any 64-bit integer."""
EXACT_BITS = 14
SKETCHED = BITS - EXACT_BITS
"""Levels 0 .. SKETCHED - 1 are sketched."""
DEPTH = 7
ERROR = 0.01
"""Wanted error of a rank, as a share of the rows; sets the counters in a row of a sketch."""
BUFFER_ROWS = 1_000_000
PATHS = 8192
CONFIDENCE = 0.9995
_HALF = 1 << (BITS - 1)


def width(error: float) -> int:
    """Counters in a row: the power of two from 16 / ``error`` up."""
    if not 0 < error < 1:
        raise ValueError("the error is a share of the rows")
    return 1 << int(np.ceil(np.log2(16 / error)))


def encoded(value: Column) -> Column:
    """Order-preserving code of 0 .. 2 ** BITS - 1 of a 64-bit integer."""
    v = value.cast("bigint")
    size = F.when(v >= 0, v).otherwise(F.bitwise_not(v))  # -1 - v
    lead = F.length(F.bin(size)) - 1
    shift = F.greatest(lead - MANTISSA, F.lit(0))
    # from 2 ** 11 up: (shift << MANTISSA) + the leading MANTISSA + 1 bits
    code = F.call_function("shiftright", size, shift) + F.call_function("shiftleft", shift.cast("bigint"), F.lit(MANTISSA))
    return F.when(v >= 0, _HALF + code).otherwise(_HALF - 1 - code)


def _size_range(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least size with a code's sign removed, and how many lie above it under the same code."""
    shift = np.maximum((code >> MANTISSA) - 1, 0)
    return (code - (shift << MANTISSA)) << shift, (np.int64(1) << shift) - 1


def decoded(code: np.ndarray) -> np.ndarray:
    """The middle of the values of each code, exact where the code holds one value."""
    negative = code < _HALF
    low, more = _size_range(np.where(negative, _HALF - 1 - code, code - _HALF).astype(np.int64))
    size = low + more / 2
    return np.where(negative, -1 - size, size)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _cells(node: np.ndarray, level: int, row: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of nodes in a row of a sketched level."""
    with np.errstate(over="ignore"):
        h = _mixed(node.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + level * DEPTH + row))
    return (h & np.uint64(w - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


@lru_cache
def _absent(level: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs, by row, of nodes that no code has."""
    nodes = np.arange(PATHS) + (1 << (BITS + level))
    cells = [_cells(nodes, level, row, w) for row in range(DEPTH)]
    return np.array([c for c, _ in cells]), np.array([s for _, s in cells], np.int8)


class Sketch:
    """The counters of one group: the sketched levels, and the lowest level counted exactly."""

    def __init__(self, w: int) -> None:
        self.w = w
        self.signed = np.zeros((SKETCHED, DEPTH, w), np.int64)
        self.exact = np.zeros(1 << EXACT_BITS, np.int64)

    def add(self, other: Sketch) -> None:
        self.signed += other.signed
        self.exact += other.exact

    @property
    def total(self) -> int:
        return int(self.exact.sum())

    def packed(self) -> bytes:
        """The counters in the smallest integers that hold them, compressed: many signed ones without repetitions by entropy alone."""
        parts = []
        for counters in (self.signed.ravel(), self.exact):
            most = int(np.abs(counters).max())
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
            strategy = zlib.Z_HUFFMAN_ONLY if np.count_nonzero(counters) * 8 > len(counters) else zlib.Z_DEFAULT_STRATEGY
            squeeze = zlib.compressobj(6, strategy=strategy)
            body = squeeze.compress(counters.astype(kind).tobytes()) + squeeze.flush()
            parts.append(bytes([np.dtype(kind).itemsize]) + len(body).to_bytes(4, "little") + body)
        return self.w.to_bytes(4, "little") + b"".join(parts)

    @staticmethod
    def unpacked(blob: bytes) -> Sketch:
        out = Sketch(int.from_bytes(blob[:4], "little"))
        at, parts = 4, []
        for _ in range(2):
            size = int.from_bytes(blob[at + 1 : at + 5], "little")
            parts.append(np.frombuffer(zlib.decompress(blob[at + 5 : at + 5 + size]), f"<i{blob[at]}").astype(np.int64))
            at += 5 + size
        out.signed, out.exact = parts[0].reshape(out.signed.shape), parts[1]
        return out

    def estimate(self, node: np.ndarray, level: int) -> np.ndarray:
        if level >= SKETCHED:
            return np.add.reduceat(self.exact, np.arange(0, len(self.exact), 1 << (level - SKETCHED)))[node].astype(float)
        rows = []
        for row in range(DEPTH):
            column, sign = _cells(node, level, row, self.w)
            rows.append(self.signed[level, row][column] * sign)
        return np.median(rows, axis=0)

    def rank_error(self) -> float:
        """Noise along random paths of nodes that can't occur, exceeded with a probability of 1 - CONFIDENCE, as a share of the total."""
        noise = np.zeros(PATHS)
        for level in range(SKETCHED):
            column, sign = _absent(level, self.w)
            noise += np.median(np.take_along_axis(self.signed[level], column, axis=1) * sign, axis=0)
        return float(np.quantile(np.abs(noise), CONFIDENCE, method="higher") / max(self.total, 1))

    def codes(self, probabilities: np.ndarray) -> np.ndarray:
        """Codes of the given ranks (the smallest with at least that share at or below it)."""
        left = np.maximum(np.ceil(probabilities * self.total), 1.0)
        node = np.zeros(len(left), np.int64)
        for level in range(BITS - 1, -1, -1):
            node = node << 1
            low = np.maximum(self.estimate(node, level), 0)
            right = left > low
            left = np.where(right, left - low, left)
            node = node + right
        return node


def _sketches(group: np.ndarray, code: np.ndarray, weight: np.ndarray, groups: int, w: int) -> Iterator[Sketch]:
    """The sketches of groups 0 .. ``groups`` - 1, some at a time so that their counters fit into 64 MB."""
    order = np.argsort(group, kind="stable")
    group, code, weight = group[order], code[order], weight[order]
    step = max(1, (1 << 23) // (SKETCHED * DEPTH * w + (1 << EXACT_BITS)))
    for first in range(0, groups, step):
        n = min(step, groups - first)
        lo, hi = np.searchsorted(group, (first, first + n))
        g, c, x = group[lo:hi] - first, code[lo:hi], weight[lo:hi]
        count = lambda cell, by, size: np.bincount(g * size + cell, by, n * size).reshape(n, size)  # noqa: B023, E731
        exact = count(c >> SKETCHED, x, 1 << EXACT_BITS)
        signed = np.empty((n, SKETCHED, DEPTH, w))
        for level in range(SKETCHED):
            for row in range(DEPTH):
                column, sign = _cells(c >> level, level, row, w)
                signed[:, level, row] = count(column, sign * x, w)
        for i in range(n):
            s = Sketch(w)
            s.exact, s.signed = exact[i].astype(np.int64), signed[i].astype(np.int64)
            yield s


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def sketch(values: DataFrame, group: Sequence[str], value: str, *, weight: Column | None = None, error: float = ERROR, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Sketches of the non-NULL values of each group: the ``group`` columns and ``sketch`` (binary), one or more rows per group and task.

    ``value`` is any integer column; ``weight`` counts a row more than once, or takes it away again (-1).
    """
    w = width(error)
    names = [*group]
    n = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    rows = values.where(F.col(value).isNotNull()).select(*group, encoded(F.col(value)).cast("int").alias("_code"), n.alias("_n"))

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        at = t.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy() if names else np.zeros(t.num_rows, np.int64)
        _, first = np.unique(at, return_index=True)
        blobs = [s.packed() for s in _sketches(at, t["_code"].to_numpy().astype(np.int64), t["_n"].to_numpy(), len(first), w)]
        keys = [t[n].take(pa.array(first)).combine_chunks() for n in names]
        yield from pa.table([*keys, pa.array(blobs, pa.binary())], [*names, "sketch"]).to_batches(max_chunksize=1000)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= buffer_rows:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(partial, _fields(values, group) + "sketch binary")


def merge(sketches: DataFrame, group: Sequence[str]) -> DataFrame:
    """The sum of sketches: those of several tasks, files or days, or of insertions and deletions; one row per ``group``.

    Sketches of a group are added as they stream by, two at a time in memory. All must have been built with one ``error``.
    """
    names = [*group]
    slim = sketches.select(*names, "sketch")
    ordered = slim.repartition(*names).sortWithinPartitions(*names) if names else slim.coalesce(1)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list[pa.Array] = []
        total: Sketch | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key, pa.array([total.packed()], pa.binary())], [*names, "sketch"])

        for b in batches:
            for i in range(b.num_rows):
                here = [b.column(n).slice(i, 1) for n in names]
                s = Sketch.unpacked(b.column("sketch")[i].as_py())
                if total is not None and all(x.equals(y) for x, y in zip(here, key)):
                    if s.w != total.w:
                        raise ValueError("sketches of different errors can't be added")
                    total.add(s)
                    continue
                if total is not None:
                    yield row()
                key, total = here, s
        if total is not None:
            yield row()

    return ordered.mapInArrow(added, _fields(sketches, group) + "sketch binary")


def percentiles(merged: DataFrame, group: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Percentiles of merged sketches: the ``group`` columns, ``n``, ``rank_error``, ``probability``, ``value``, and ``low`` and
    ``high``, the least and the greatest value of the code found.

    At most a share of ``rank_error`` of the rows lies between the code and the rank. A group of
    total weight 0 or less gives no rows.
    """
    names = [*group]
    ps = np.array(sorted(probabilities), dtype=float)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Sketch.unpacked(b.column("sketch")[i].as_py())
                if s.total <= 0:
                    continue
                found = s.codes(ps)
                negative = found < _HALF
                low, more = _size_range(np.where(negative, _HALF - 1 - found, found - _HALF).astype(np.int64))
                k = len(ps)
                keys = [b.column(n).take(pa.array([i] * k)) for n in names]
                out = [pa.array([s.total] * k, pa.int64()), pa.array([s.rank_error()] * k), pa.array(ps), pa.array(decoded(found)), pa.array(np.where(negative, -1 - low - more, low)), pa.array(np.where(negative, -1 - low, low + more))]
                yield pa.RecordBatch.from_arrays([*keys, *out], [*names, "n", "rank_error", "probability", "value", "low", "high"])

    return merged.mapInArrow(descend, _fields(merged, group) + "n bigint, rank_error double, probability double, value double, low bigint, high bigint")
