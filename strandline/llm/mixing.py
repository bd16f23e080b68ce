"""Mixing sources to target weights under caps on repetition, by temperature.

Sizes are tokens of a public tokenizer. A source's weight is ``base * (share / base) ** a``, normalised: its share of all
tokens, exponentiated relative to a base measure. Exponent 1 gives the natural shares (every document equally
often), exponent 0 the base. With equal bases that is the usual ``share ** a``; with the target shares as the base, exponent
0 is the target itself. The exponent is bisected to the least at which no source must be repeated more
often than allowed at the wanted total, or to the one of a wanted entropy; what no exponent can meet saturates at the caps.
Policy ``exact`` keeps the target shares and shrinks the total instead.

Weights become budgets in tokens. A budget is realised as whole passes over the source and
a last, partial one over a random permutation of blocks of documents: whole blocks in
their order, and a prefix of one block. Blocks hold about ``BLOCK_TOKENS`` tokens; only block totals are ordered per source, so a source of
any size is spread over all tasks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import spread

#: Splitting pattern of the byte-level vocabularies: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 22
#: Rows of a plan that are sent to every task: about 100 bytes each.
MAX_BROADCAST_ROWS = 100_000
_encodings: dict[str, object] = {}


def _encoding(vocabulary: str):
    """The tokenizer of a vocabulary file that was sent to the executors, kept per process."""
    if vocabulary not in _encodings:
        import tiktoken

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _encodings[vocabulary] = tiktoken.Encoding("strandline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: Column, *, vocabulary: str) -> DataFrame:
    """``doc_id``, ``source`` (the column ``keep``) and ``n_tokens`` of the whole text; NULL and empty texts have 0.

    ``vocabulary``: path or address of a byte-level vocabulary, one base64 token and its rank per line, which is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    staged = docs.select(F.col(doc_id).alias("doc_id"), keep.alias("source"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(name).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return spread(staged).mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, no blanks around, ``-`` for ``_``."""
    return F.translate(F.lower(F.trim(source)), "_ ", "--")


@dataclass
class Source:
    name: str
    tokens: int
    target: float
    max_repeats: float
    weight: float = 0.0
    budget: float = 0.0


def _normalised(xs: list[float]) -> list[float]:
    total = sum(xs)
    return [x / total if total else 0.0 for x in xs]


def tempered(natural: list[float], base: list[float], a: float) -> list[float]:
    """Weights of exponent ``a``; sources without text or base weigh nothing."""
    return _normalised([b * (n / b) ** a if n > 0 and b > 0 else 0.0 for n, b in zip(natural, base)])


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(natural: list[float], base: list[float], holds, *, most: float = 1.0, steps: int = 60) -> float:
    """The least exponent in 0 .. ``most`` at which ``holds(weights)``; ``most`` if it never does."""
    low, high = 0.0, most
    if holds(tempered(natural, base, 0.0)):
        return 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(tempered(natural, base, mid)) else (mid, high)
    return high


def plan(sources: list[Source], total: float | None = None, *, policy: str = "tempered", base: str = "target", most_entropy: float | None = None) -> tuple[list[Source], float, float]:
    """Weights and token budgets; returns the sources, the total and the exponent.

    ``tempered``: ``total`` (all tokens of the sources with a target, if it is not given) is kept. The exponent is the least at which the
    caps on repetition hold and the entropy is at most ``most_entropy``, if given; ``base``: ``target`` or ``equal``.
    ``exact``: weights are the target shares, and the total the greatest at which every source with text can have
    its share, or the given one if that is less. Targets of sources without any text, or with a cap of 0, are spread over the others in proportion.
    """
    usable = [s.tokens > 0 and s.max_repeats > 0 and s.target > 0 for s in sources]
    natural = _normalised([float(s.tokens) if u else 0.0 for s, u in zip(sources, usable)])
    target = _normalised([s.target if u else 0.0 for s, u in zip(sources, usable)])
    room = [s.tokens * s.max_repeats for s in sources]
    a = 0.0
    if policy == "exact":
        most = min((r / t for r, t in zip(room, target) if t > 0), default=0.0)
        total = most if total is None else min(total, most)
        weights = target
    elif policy == "tempered":
        total = float(sum(s.tokens for s, u in zip(sources, usable) if u)) if total is None else total
        start = target if base == "target" else _normalised([1.0 if u else 0.0 for u in usable])
        a = bisected(natural, start, lambda w: all(x * total <= r * (1 + 1e-12) for x, r in zip(w, room)))
        if most_entropy is not None:  # beyond 1 the largest sources gain further
            a = max(a, bisected(natural, start, lambda w: entropy(w) <= most_entropy + 1e-12, most=16.0))
        weights = tempered(natural, start, a)
    else:
        raise ValueError(f"no such policy: {policy}")
    for s, w, r in zip(sources, weights, room):
        s.weight, s.budget = w, min(w * total, r)
    return sources, total, a


def mix(counts: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, policy: str = "tempered", base: str = "target", entropy_of_targets: bool = False, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The selection and the report of a mixture.

    ``counts``: ``doc_id``, ``source``, ``n_tokens`` (written beforehand: it is read several times);
    ``targets``: ``source``, ``target_share``, ``max_repeats``. Selection: ``doc_id``, ``source``, ``n_tokens`` and
    ``copies`` (1 .. ``max_repeats``), one row per document used. Report, one row per target: ``source``,
    ``target_share``, ``exponent``, ``weight``, ``available_tokens``, ``selected_tokens``, ``reached_share``, ``repeats`` (selected by
    available), ``max_repeats``. Sources without a target and documents without a token are not used; NULL
    targets count as 0; a repeated row counts as a document of its own; no targets give no rows. A source misses its budget by less than its largest
    document. ``entropy_of_targets``: the entropy of the weights must not exceed that of the target shares.
    The targets pass the driver, one row per source.
    """
    spark = counts.sparkSession
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")).orderBy("source").collect()
    small = (lambda df: F.broadcast(df)) if len(goals) <= MAX_BROADCAST_ROWS else (lambda df: df)
    named = spark.createDataFrame([(r["source"],) for r in goals], "source string")
    used = counts.select("doc_id", "source", "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).join(small(named), "source", "left_semi")
    have = {r["source"]: r["m"] for r in used.groupBy("source").agg(F.sum("n_tokens").alias("m")).collect()}
    sources = [Source(r["source"], int(have.get(r["source"], 0)), float(r["target_share"]), float(r["max_repeats"])) for r in goals]
    wanted = entropy(_normalised([s.target if s.tokens > 0 and s.max_repeats > 0 else 0.0 for s in sources])) if entropy_of_targets else None
    sources, total, exponent = plan(sources, total_tokens, policy=policy, base=base, most_entropy=wanted)
    rows = []
    for s in sources:
        passes = math.floor(s.budget / s.tokens + 1e-9) if s.tokens else 0
        rest = max(0.0, s.budget - passes * s.tokens) if passes < s.max_repeats else 0.0
        rows.append((s.name, s.target, exponent, s.weight, s.tokens, s.max_repeats, -(-s.tokens // block_tokens), passes, float(rest)))
    budgets = spark.createDataFrame(rows, "source string, target_share double, exponent double, weight double, available_tokens bigint, max_repeats double, _blocks bigint, _passes int, _rest double")
    key = F.xxhash64("doc_id", F.lit(seed))
    usable = used.join(small(budgets.where("_blocks > 0").select("source", "_blocks")), "source").withColumn("_block", F.pmod(key, F.col("_blocks"))).withColumn("_at", F.xxhash64(key, F.lit(1)))
    # one row per source and block; the window orders blocks, not documents
    sized = usable.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("source").orderBy(F.xxhash64("_block", F.lit(seed + 1)), "_block").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("_upto", upto).join(small(budgets), "source")
    inside = F.col("_upto") <= F.col("_rest")
    cut = ~inside & (F.col("_upto") - F.col("_m") < F.col("_rest"))
    placed = placed.select("source", "_block", "_passes", inside.alias("_whole"), F.when(cut, F.col("_rest") - F.col("_upto") + F.col("_m")).alias("_part"))
    blocks = sum(r[6] for r in rows)  # the exact number of rows of ``placed`` at most
    joined = usable.join(F.broadcast(placed) if blocks <= MAX_BROADCAST_ROWS else placed, ["source", "_block"])
    running = F.sum("n_tokens").over(Window.partitionBy("source", "_block").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    partial = joined.where(F.col("_part").isNotNull()).withColumn("_more", (running <= F.col("_part")).cast("int"))
    rest = joined.where(F.col("_part").isNull()).withColumn("_more", F.col("_whole").cast("int"))
    chosen = rest.unionByName(partial).select("doc_id", "source", "n_tokens", (F.col("_passes") + F.col("_more")).alias("copies")).where(F.col("copies") > 0)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected_tokens"))
    report = budgets.join(reached, "source", "left").select("source", "target_share", "exponent", "weight", "available_tokens", F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"), "max_repeats")
    report = report.withColumn("_all", F.sum("selected_tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    report = report.select(
        "source", "target_share", "exponent", "weight", "available_tokens", "selected_tokens",
        F.when(F.col("_all") > 0, F.col("selected_tokens") / F.col("_all")).alias("reached_share"),
        F.when(F.col("available_tokens") > 0, F.col("selected_tokens") / F.col("available_tokens")).alias("repeats"), "max_repeats",
    )
    return chosen, report
