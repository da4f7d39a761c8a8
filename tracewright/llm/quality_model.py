"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of a few bins, and the score is the logistic of a sum of table
entries: one table per feature and one per chosen pair of features. Tables are learned by cyclic
boosting: round after round each feature in turn gets a small step of a shallow tree over its bins,
then the pairs that explain the rest best get theirs. Scoring is bin look-ups and additions over whole
batches.

The model is learned from a bounded sample of labelled rows (SAMPLE of those with the least hash), never
from a held-out row, and from the text alone. Texts of any length are read whole; a null text is empty
and is scored like any other. Without labels of both kinds every text gets the share of label 1 (0.5
without labels). Every row is scored, also where doc_ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import chunks, kept_columns, quoted

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, DEPTH = 150, 60, 0.15, 2
LEAST_HESSIAN = 2.0
CUT = 0.3

FEATURES = ["words", "word_length", "symbols", "bars", "upper", "exclaims", "stops", "digits", "distinct", "echoes", "line_words", "line_repeats", "beyond_ascii", "other_marks"]
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", "#*$%&<>", "|", "!", ".,;:?"]
CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    CLASS[[ord(c) for c in _chars]] = _k
CLASS[128:192] = len(_CLASSES) + 1  # bytes within a character
CLASS[192:] = len(_CLASSES) + 2  # first bytes of one
KINDS = len(_CLASSES) + 3


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    kind = np.bincount(np.repeat(np.arange(len(texts)) * KINDS, sizes) + CLASS[data], minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(float)
    words, distinct, echoes, lines, repeats = (np.zeros(len(texts)) for _ in range(5))
    for k, t in enumerate(texts):
        w = t.split()
        words[k], distinct[k], echoes[k] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
        ls = [x for x in t.split(b"\n") if x]
        lines[k], repeats[k] = len(ls), len(ls) - len(set(ls))
    low, up, digit, space, symbol, bar, bang, stop, other, _, first = kind.T
    n = np.maximum(words, 1)
    marks = np.maximum(low + up + digit + symbol + bar + bang + stop + other + first, 1)
    return np.stack([np.log1p(words), marks * (words > 0) / n, symbol / n, bar / n, up / np.maximum(low + up, 1), bang / n, stop / n, digit / marks, distinct / n, echoes / n, np.log1p(words / np.maximum(lines, 1)), repeats / np.maximum(lines, 1), first / marks, other / n], 1)


@dataclass
class Model:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The value of each bin under a tree of ``depth`` on gradient and hessian sums of bins in order."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        ok = (b >= LEAST_HESSIAN) & (h.sum() - b >= LEAST_HESSIAN)
        gain = np.where(ok, a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1), -np.inf)
        k = int(gain.argmax()) + 1
        if np.isfinite(gain[k - 1]):
            return np.concatenate([tree(g[:k], h[:k], depth - 1), tree(g[k:], h[k:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a table of sums: its gain and the values of its four parts."""
    best, value = 0.0, np.zeros_like(g)
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            sums = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(x * x / (y + 1) for x, y in zip(*sums))
            if gain > best:
                v = [x / (y + 1) for x, y in zip(*sums)]
                best, value = gain, np.block([[np.full((i + 1, j + 1), v[0]), np.full((i + 1, g.shape[1] - j - 1), v[1])], [np.full((g.shape[0] - i - 1, j + 1), v[2]), np.full((g.shape[0] - i - 1, g.shape[1] - j - 1), v[3])]])
    return best, value


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(start=float(np.log(p / (1 - p))))
    cuts = lambda n: [np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) for k in range(x.shape[1])]
    m = Model(start=float(np.log(y.mean() / (1 - y.mean()))), edges=cuts(BINS), pair_edges=cuts(PAIR_BINS))
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.start)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(ROUNDS):
        for t, b in zip(m.tables, bins):
            g, h = slope()
            step = RATE * tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), DEPTH)
            t += step
            z += step[b]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(m.pair_edges)]
    shape = lambda a, b: (len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)

    def sums(a, b, w):
        s = shape(a, b)
        return np.bincount(coarse[a] * s[1] + coarse[b], w, s[0] * s[1]).reshape(s)

    g, h = slope()
    gains = {(a, b): quadrants(sums(a, b, g), sums(a, b, h))[0] for a, b in combinations(range(x.shape[1]), 2)}
    m.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    m.pair_tables = [np.zeros(shape(*p)) for p in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(m.pairs, m.pair_tables):
            g, h = slope()
            step = RATE * quadrants(sums(a, b, g), sums(a, b, h))[1]
            t += step
            z += step[coarse[a], coarse[b]]
    return m


def bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def of_batches(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text"), 2 << 20):
            raw = c.data.tobytes()
            yield use(b, pa.array(c.rows), features([raw[i:j] for i, j in zip(c.at[:-1].tolist(), c.at[1:].tolist())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & (bucket(F.col("label_id"), 5) != 0))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    # where a doc_id or its label repeats, one row counts: at most ``sample`` rows
    rows = rows.groupBy("label_id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def measured(batches):
        return of_batches(batches, lambda b, at, x: pa.RecordBatch.from_arrays([b.column("y").take(at), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"]))

    got = rows.mapInArrow(measured, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r.y, r.x))
    return learn(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score."""

    def score(batches):
        return of_batches(batches, lambda b, at, x: pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(model.score(x))], names=["doc_id", "score"]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    got = scored(docs, fit(docs, labels, sample=sample))
    return got.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    model = fit(docs, labels, sample=sample)
    def keep(batches):
        def kept(b, at, x):
            return b.take(at.filter(pa.array(model.score(x) >= cut)))

        return of_batches(batches, kept)

    rows = docs.select(kept_columns(docs).alias("rest"), "text")
    return rows.mapInArrow(keep, rows.schema).select(*("text" if c == "text" else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns))
