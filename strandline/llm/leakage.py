"""Evaluation texts leaking into a corpus: a prefix-filtered set join with positional verification.

A leak is a run of ``window`` successive words of an item inside one text part of a document.
Seen as sets of word shingles, the window's shingles must all occur in the part, so joining one
of them is enough; joining the rarest keeps candidates few. The steps:

1. The items become a table of words and shingle keys. Their keys also fill a bit map of bounded size, which
   every task holds; it may let shingles through that no item has, but keeps none back.
2. One pass over the whole texts, however many items there are: words, the keys of their shingles of ``shingle`` words, and
   the runs of successive keys in the bit map that are long enough for a window (length bound). Only these runs leave the
   pass, with their words, and are written to the checkpoint folder, since they are read again.
3. Rarity: the number of parts with each shingle, over all runs.
4. Prefix: of every item window its rarest shingle, with its offset in the item.
5. Join of the runs' keys with the prefixes. Positional bound: the window, aligned at the hit, must lie inside the run.
6. Verification: the window's words equal the item's, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.messages import part_words, words
from strandline.session import checkpointed, spread

WINDOW = 12
SHINGLE = 5
MAP_BITS = 27
"""Bits of an address in the map of item shingles at most: 16 MB in every task. Beyond some ten million shingles it lets more through."""
KEPT_WORDS = 500_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


class _WordKeys(dict):
    """64-bit keys of words, computed once per word while there is room."""

    def __missing__(self, word: str) -> int:
        key = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = key
        return key


def _shingle_keys(ws: list[str], k: int, keys: _WordKeys) -> np.ndarray:
    """A 64-bit key for the ``k`` successive words at every position."""
    n = len(ws) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ids = np.array([keys[w] for w in ws], np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(k):
            key = (key ^ ids[i : i + n]) * _MULT
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _addresses(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two addresses in a map of ``2 ** bits`` bits."""
    u = keys.view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int64)


def _marked(bit_map: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = _addresses(keys, bits)
    return (bit_map[a >> 3] >> (a & 7).astype(np.uint8)) & (bit_map[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def _item_table(items: DataFrame, item_id: str, item_text: str, window: int, k: int) -> DataFrame:
    """Distinct items with a window: ``item_id``, ``no`` (a hash of the text), ``words`` and ``keys`` of the shingles."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _WordKeys()
        for b in batches:
            rows = []
            for i, no, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(t)
                if len(ws) >= window:
                    rows.append((i, no, ws, _shingle_keys(ws, k, held)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], ["item_id", "no", "words", "keys"])

    return rows.select("i", F.xxhash64("t").alias("no"), "t").mapInArrow(parse, "item_id bigint, no bigint, words array<string>, keys array<bigint>")


def _bit_map(items: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """The map of the items' shingles, 32 bits each up to ``2 ** most_bits`` bits, put together from the slices that tasks fill."""
    total = items.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(most_bits, max(16, int(np.ceil(np.log2(32 * total + 1)))))
    size = 1 << (bits - 3)
    piece = min(size, 1 << 13)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for b in batches:
            for at in _addresses(np.asarray(b.column(0).flatten()), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = held.reshape(-1, piece)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["slice", "bits"])

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [both.tobytes()]})

    schema = "slice int, bits binary"
    pieces = items.select("keys").mapInArrow(fill, schema).groupBy("slice").applyInPandas(united, schema)
    out = np.zeros(size, np.uint8)
    for r in pieces.toLocalIterator():  # as large as the map at most
        out[r["slice"] * piece : (r["slice"] + 1) * piece] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _runs(docs: DataFrame, doc_id: str, text: str, bit_map: np.ndarray, bits: int, window: int, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bit_map)
    least = window - k + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks = _WordKeys(), shared.value
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None:
                    continue
                for part, ws in enumerate(part_words(t)):
                    if len(ws) < window:
                        continue
                    keys = _shingle_keys(ws, k, held)
                    hit = np.concatenate(([False], _marked(marks, keys, bits), [False]))
                    edges = np.flatnonzero(hit[1:] != hit[:-1])
                    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        if end - start >= least:
                            rows.append((d, part, start, keys[start:end], ws[start : end + k - 1]))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "part", "start", "keys", "words"])

    return spread(docs.select(F.col(doc_id).cast("bigint"), F.col(text))).mapInArrow(scan, "doc_id bigint, part int, start int, keys array<bigint>, words array<string>")


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", window: int = WINDOW, shingle: int = SHINGLE, map_bits: int = MAP_BITS) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` of messages that hold ``window`` successive words of an item in one text part.

    ``shingle`` must not exceed ``window``. Words are compared without case; markup, punctuation and
    line breaks between words do not count. NULL ids and texts match nothing, as do items shorter
    than a window; repeated items and documents give each pair once; an empty side gives no rows; other columns are ignored.
    """
    if shingle > window:
        raise ValueError("a shingle must fit into a window")
    table = checkpointed(_item_table(items, item_id, item_text, window, shingle))
    bit_map, bits = _bit_map(table, map_bits)
    runs = checkpointed(_runs(docs, doc_id, text, bit_map, bits, window, shingle))
    per_window = window - shingle + 1
    places = table.select("item_id", "no", F.posexplode("keys").alias("spot", "key"))
    rarity = runs.select("doc_id", "part", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    # every window of every item, by the shingles it needs; a shingle no run has makes the window impossible
    seen = places.join(rarity, "key")
    windows = (
        seen.select("item_id", "no", "spot", "key", "df", F.explode(F.sequence(F.greatest(F.col("spot") - (per_window - 1), F.lit(0)), F.col("spot"))).alias("window"))
        .groupBy("item_id", "no", "window")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("df", "key", "spot")).alias("_r"))
        .where(F.col("_n") == per_window)
    )
    prefixes = windows.groupBy(F.col("_r.key").alias("key"), "item_id", "no", F.col("_r.spot").alias("spot")).agg(F.min("window").alias("first"), F.max("window").alias("last"))
    run, item = ["doc_id", "part", "start"], ["item_id", "no"]
    hits = runs.select(*run, F.size("words").alias("n"), F.posexplode("keys").alias("at", "key")).join(prefixes, "key")
    # positional bound: some window with this prefix must start at or after the run and end within it
    begin = F.col("at") - F.col("spot")  # where the item's first word would be, counted in the run
    bounds = [F.greatest(F.col("first"), -begin).alias("_lo"), F.least(F.col("last"), F.col("n") - window - begin).alias("_hi")]
    hits = hits.select(*run, *item, begin.alias("begin"), *bounds).where(F.col("_lo") <= F.col("_hi"))
    # one candidate per run, item and alignment, however many of its shingles are prefixes; the words come last
    candidates = hits.groupBy(*run, *item, "begin").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    checked = candidates.join(runs.select(*run, "words"), run).join(table.select(*item, F.col("words").alias("item_words")), item)
    checked = checked.where(F.exists(F.sequence("_lo", "_hi"), lambda w: F.slice("words", F.col("begin") + w + 1, F.lit(window)) == F.slice("item_words", w + 1, F.lit(window))))
    return checked.select("doc_id", "item_id").distinct()
