"""Language of documents and their passages: sparse logistic regression on character n-grams.

Features of a passage are the TF-IDF weights of the character n-grams of its words (marked at
both ends), hashed, divided by their sum. A multinomial logistic regression is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled
documents, cleaned once of passages that contradict a first fit, and calibrated by a temperature
on held-out passages. As features are sums over words, the weights of a word are added up
once and kept: scoring a passage is one look-up per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.messages import all_passages, paragraphs
from strandline.session import spread

#: The languages, with their ISO 639 codes and English names.
LANGUAGES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
}
NAMES = sorted(LANGUAGES)

SAMPLE_DOCUMENTS = 1500
"""Bound on the labelled documents the classifier is fitted on."""
LEAST_WORDS = 12


def label_language(label: Column) -> Column:
    """The language a label names, or NULL: a code or an English name, in any case, with or without a region or blanks."""
    bare = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(bare, r"\s*[-_ (].*$", "")
    known = F.create_map(*[F.lit(x) for lang, names in LANGUAGES.items() for name in (lang, *names) for x in (name, lang)])
    return F.try_element_at(known, bare)


HASH_BITS = 17


def _grams(word: str) -> np.ndarray:
    w = f"<{word}>"
    n = len(w)
    return np.array([zlib.crc32(w[i : i + k].encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for k in (1, 2, 3) for i in range(n - k + 1)], np.int64)


@dataclass
class Model:
    """Weights (n-gram, language), inverse document frequencies, bias and temperature."""

    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    scale: float = 40.0

    def word(self, w: str) -> np.ndarray:
        """Summed weighted logits of a word, and its TF-IDF mass at the end."""
        g = _grams(w)
        v = self.idf[g]
        return np.append(v @ self.weights[g], v.sum())


class Scorer:
    """Probabilities of passages, with the vectors of seen words kept (up to ``keep`` of them)."""

    def __init__(self, model: Model, keep: int = 200_000) -> None:
        self.model, self.keep = model, keep
        self.at: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(model.bias) + 1))

    def _number(self, w: str) -> int:
        n = self.at[w] = len(self.at)
        if n >= len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        if w.isalpha():
            self.vectors[n] = self.model.word(w)
        else:  # numbers and codes say nothing about the language
            self.vectors[n] = 0
        return n

    def _ids(self, ws: list[str]) -> list[int]:
        get, number = self.at.get, self._number
        return [i if (i := get(w)) is not None else number(w) for w in ws]

    def segments(self, ws: list[str], *, window: int = 5, least: int = 4, switch: float = -6.0) -> list[tuple[int, int, int, float]]:
        """Runs of words of one language: first word, number of words, language, confidence.

        Every word gets the probabilities of the window around it; where all windows agree the passage is one
        run, else the best sequence is sought in which a change of language costs ``switch`` (log probability) and runs
        shorter than ``least`` words fall to the one before (or after, at the start).
        """
        if len(self.at) > self.keep:
            self.at.clear()
        ids = self._ids(ws)
        v = self.vectors[np.array(ids, np.int64)]
        total = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)))
        n, half = len(ws), window // 2
        lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
        p = self._softmax(total[hi] - total[lo])
        whole = self._softmax(total[-1:])[0]
        known = total[hi][:, -1] - total[lo][:, -1] > 0
        if (p.argmax(axis=1)[known] == whole.argmax()).all():
            return [(0, n, int(whole.argmax()), float(whole.max()))]
        score = np.log(np.maximum(p, 1e-9))
        best, back = score[0], np.zeros((n, score.shape[1]), np.int64)
        for i in range(1, n):
            top = best.argmax()
            stay = best >= best[top] + switch
            back[i] = np.where(stay, np.arange(len(best)), top)
            best = np.where(stay, best, best[top] + switch) + score[i]
        path = [int(best.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
        cuts = [0, *[i for i in range(1, n) if path[i] != path[i - 1]], n]
        runs = [[a, z, path[a]] for a, z in zip(cuts, cuts[1:])]
        joined: list[list[int]] = []
        for r in runs:
            if joined and (r[1] - r[0] < least or r[2] == joined[-1][2]):
                joined[-1][1] = r[1]
            elif joined and joined[-1][1] - joined[-1][0] < least:
                joined[-1][1:] = r[1:]
            else:
                joined.append(r)
        out = []
        for a, z, lang in joined:
            q = self._softmax(total[z : z + 1] - total[a : a + 1])[0]
            out.append((a, z - a, lang, float(q[lang])))
        return out

    def _softmax(self, sums: np.ndarray) -> np.ndarray:
        logits = self.model.scale * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + self.model.bias
        return softmax(logits / self.model.temperature)

    def probabilities(self, passages: Sequence[list[str]]) -> np.ndarray:
        if not passages:
            return np.zeros((0, len(self.model.bias)))
        if len(self.at) > self.keep:
            self.at.clear()
        ids: list[int] = []
        starts = []
        for ws in passages:
            starts.append(len(ids))
            ids += self._ids(ws)
        return self._softmax(np.add.reduceat(self.vectors[np.array(ids, np.int64)], np.array(starts), axis=0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(passages: Sequence[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    cache: dict[str, np.ndarray] = {}
    out = []
    for ws in passages:
        parts = []
        for w in ws:
            if w.isalpha():
                if w not in cache:
                    cache[w] = _grams(w)
                parts.append(cache[w])
        out.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64)))
    return out


def inverse_frequencies(df: np.ndarray, passages: int) -> np.ndarray:
    return np.log((1 + passages) / (1 + df)) + 1.0


def _ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, classes: int, *, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, epochs: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net; returns sparse weights and the bias."""
    dim = 1 << HASH_BITS
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))
    rng = np.random.default_rng(seed)

    def current(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(xs)):
            i, v = xs[r]
            i, v = np.append(i, dim), np.append(v, 1.0)  # the last coordinate is the bias
            w = current(i)
            logits = v @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[ys[r]] -= 1.0
            g = v[:, None] * p
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha * w
            n[i] += g2
    w = current(np.arange(dim + 1))
    return w[:dim], w[dim]


def fit(passages: Sequence[list[str]], labels: Sequence[int], held_out: Sequence[bool], folds: Sequence[int], classes: int = len(NAMES), idf: np.ndarray | None = None) -> Model:
    """Drop the passages whose label a fit on the other half contradicts, fit the rest, calibrate on held-out ones.

    Passages of one document should have one value of ``folds``. ``idf`` is that of the passages, if none is given.
    """
    ys, out = np.asarray(labels), np.asarray(held_out, bool)
    raw = _features(passages)
    dim = 1 << HASH_BITS
    if idf is None:
        df = np.zeros(dim)
        for i, _ in raw:
            df[i] += 1
        idf = inverse_frequencies(df, len(raw))
    model = Model(np.zeros((dim, classes)), idf, np.zeros(classes))
    xs = []
    for i, c in raw:
        v = c * idf[i]
        xs.append((i, model.scale * v / max(v.sum(), 1e-9)))
    kept = np.array([len(i) > 0 for i, _ in xs], bool)
    # each half is judged by a fit on the other one, which can't have learnt its wrong labels by heart
    half = np.asarray(folds, int) % 2
    good = kept.copy()
    for side in (0, 1):
        use = np.flatnonzero(kept & ~out & (half == side))
        if len(use):
            w, bias = _ftrl([xs[r] for r in use], ys[use], classes)
            good &= (half == side) | np.array([len(i) > 0 and int((v @ w[i] + bias).argmax()) == y for (i, v), y in zip(xs, ys)], bool)
    use = np.flatnonzero(good & ~out)
    if not len(use):
        return model
    model.weights, model.bias = _ftrl([xs[r] for r in use], ys[use], classes)
    logits = np.array([v @ model.weights[i] + model.bias for i, v in xs])
    check = np.flatnonzero(good & out)
    if len(check):
        model.temperature = _temperature(logits[check], ys[check])
    return model


def _temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm; it never sharpens."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(ys)), ys], 1e-12)).mean())

    a, b, g = 0.0, np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _paragraph_rows(docs: DataFrame, keep: str, types: str, least: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, ws) for d, k, t in zip(*(c.to_pylist() for c in b.columns)) for ws in paragraphs(t, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.string())))], ["doc_id", keep, "words"])

    return docs.select("doc_id", keep, "text").mapInArrow(parse, f"doc_id bigint, {keep} {types}, words array<string>")


def corpus_idf(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, keep: int = 200_000) -> np.ndarray:
    """Inverse document frequencies of the hashed n-grams over the passages of all documents.

    A task counts in an array of fixed size (and keeps the n-grams of up to ``keep`` words); the counts are summed by n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = 1 << HASH_BITS
        df, cache = np.zeros(dim + 1, np.int64), {}  # the last one counts the passages
        for b in batches:
            for t in b.column(0).to_pylist():
                for ws in paragraphs(t, least_words):
                    parts = []
                    for w in ws:
                        if w.isalpha():
                            if (g := cache.get(w)) is None:
                                g = cache[w] = _grams(w)
                            parts.append(g)
                    df[dim] += 1
                    if parts:
                        df[np.concatenate(parts)] += 1  # an index that is repeated counts once
                if len(cache) > keep:
                    cache.clear()
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], ["gram", "n"])

    rows = spread(docs.select(F.col(text).alias("text"))).mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << HASH_BITS) + 1, np.int64)
    df[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return inverse_frequencies(df[:-1], int(df[-1]))


def quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many of each language's labelled documents to take, ``total`` together (all, if there are fewer): a quarter of
    ``total`` in equal parts, as far as a language has so many, and the rest in proportion to what is left."""
    taken = {k: min(n, total // (4 * len(counts))) for k, n in counts.items()}
    left = {k: n - taken[k] for k, n in counts.items()}
    room, rest = min(total, sum(counts.values())) - sum(taken.values()), max(1, sum(left.values()))
    more = {k: room * n // rest for k, n in left.items()}
    short = room - sum(more.values())
    for k in sorted(left, key=lambda k: (-(room * left[k] % rest), k))[:short]:
        more[k] += 1
    return {k: taken[k] + more[k] for k in counts}


def _sampled(labelled: DataFrame, counts: dict[str, int], quota: dict[str, int]) -> DataFrame:
    """The documents of least hash in each language, as many as its quota.

    Only about twice the quota (and 64) are ordered: those below a bar on the 64-bit hash, set by the language's own count.
    """
    if not counts:
        return labelled
    of = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[F.col("lang")]
    bars = {k: min(2**63 - 1, 2**64 * (2 * quota[k] + 64) // n - 2**63) for k, n in counts.items()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id"))
    hashed = labelled.withColumn("_key", F.xxhash64("doc_id", F.lit(11))).where(F.col("_key") <= of(bars))
    return hashed.withColumn("_place", place).where(F.col("_place") <= of(quota)).drop("_key", "_place")


def trained(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_documents: int = SAMPLE_DOCUMENTS, least_words: int = LEAST_WORDS) -> Model:
    """A model fitted on the passages of ``sample_documents`` labelled documents (of all, if there are fewer), chosen
    by a hash of their id with a quota for each language. The n-grams' frequencies are those of all documents."""
    labelled = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), label_language(F.col(label)).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    got = _paragraph_rows(_sampled(labelled, counts, quotas(counts, sample_documents)), "lang", "string", least_words).collect()
    order = {n: i for i, n in enumerate(NAMES)}
    rows = sorted(((r["doc_id"], r["lang"], r["words"]) for r in got), key=lambda r: (r[0], r[2]))
    codes = [zlib.crc32(str(r[0]).encode()) for r in rows]
    return fit([r[2] for r in rows], [order[r[1]] for r in rows], [c % 5 == 0 for c in codes], [c // 5 for c in codes], idf=corpus_idf(docs, text, least_words))


def _passages(message: str | None, least: int) -> list[list[str]]:
    return all_passages(message) if least <= 1 else paragraphs(message, least)


def passage_languages(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", least_words: int = LEAST_WORDS) -> DataFrame:
    """Every passage of running text: ``doc_id``, ``label_lang`` (what the document's label names, or NULL), ``passage``
    (number in the document), ``n_words``, ``lang``, ``confidence``.

    With ``least_words`` of 1 every message with a word of letters has a passage: its whole text, if it has no paragraph of
    running text. Documents without such a passage, with a NULL id or text give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            ids, labels, number, sizes, passages = [], [], [], [], []
            for d, named, t in zip(*(c.to_pylist() for c in b.columns)):
                if d is None:
                    continue
                for i, ws in enumerate(_passages(t, least_words)):
                    ids.append(d)
                    labels.append(named)
                    number.append(i)
                    sizes.append(len(ws))
                    passages.append(ws)
            p = scorer.probabilities(passages)
            best = p.argmax(axis=1)
            names = pa.array(NAMES).take(pa.array(best, pa.int64()))
            columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(number, pa.int32()), pa.array(sizes, pa.int32()), names, pa.array(p.max(axis=1) if len(p) else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label_lang", "passage", "n_words", "lang", "confidence"])

    staged = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), label_language(F.col(label)).alias("label_lang"), F.col(text).alias("text"))
    return spread(staged).mapInArrow(score, "doc_id bigint, label_lang string, passage int, n_words int, lang string, confidence double")


def passage_segments(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of one language inside every passage of running text: ``doc_id``, ``passage``, ``segment`` (number in the
    passage), ``first_word`` (from 0), ``n_words``, ``lang``, ``confidence``. A passage in one language is one segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "passage", "segment", "first_word", "n_words", "lang", "confidence"]
    types = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.float64()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = [
                (d, i, k, first, n, NAMES[lang], confidence)
                for d, t in zip(*(c.to_pylist() for c in b.columns))
                if d is not None
                for i, ws in enumerate(_passages(t, least_words))
                for k, (first, n, lang, confidence) in enumerate(scorer.segments(ws))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(split, "doc_id bigint, passage int, segment int, first_word int, n_words int, lang string, confidence double")


def document_languages(passages: DataFrame) -> DataFrame:
    """One row per document and language: ``doc_id``, ``lang``, ``n_words``, ``share`` of the words, ``confidence`` (word-weighted mean)."""
    per = passages.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    all_ = passages.groupBy("doc_id").agg(F.sum("n_words").alias("_all"))
    return per.join(all_, "doc_id").select("doc_id", "lang", "n_words", (F.col("n_words") / F.col("_all")).alias("share"), "confidence")


def unlabelled_languages(passages: DataFrame) -> DataFrame:
    """``doc_id`` and ``lang`` of the languages of passages that the document's label does not name."""
    return passages.where(~F.col("lang").eqNullSafe(F.col("label_lang"))).select("doc_id", "lang").distinct()
