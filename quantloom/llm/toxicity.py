"""Toxicity scores by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed words and word beginnings is trained on confirmed toxic
documents (P) and unlabelled documents (U) with the class-prior-corrected risk
    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),
whose second part is kept from going negative, so that the fit cannot treat the toxic documents
hidden in U as negatives. pi is the share of toxic rows among the labels of the training fold. A
slope and an offset fitted on that fold's labels turn margins into probabilities.

Features are chosen by how often they are in P and in U, which is counted over every different text of the
training fold. The gradient steps are on a bounded sample: MAX_POSITIVE and MAX_UNLABELLED documents, chosen by
a hash of the id. Every document is scored on its whole text. lang, source, labels and doc_id are never inputs.

Defined results: null and empty texts have no features and get the score of the offset; without any
toxic label all scores are below 1e-15; null doc_ids count as not held out and are scored; repeated rows
are scored each; of the rows of a repeated doc_id the sample has one, that with the least bytes of features; repeated labels count as toxic if any says so; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import BoundedTable, arrow_rows, held_out, table

MAX_POSITIVE, MAX_UNLABELLED = 2000, 5000
THRESHOLD = 0.3
#: Lengths of word beginnings that are features besides the whole word. Each is a feature for
#: being there once, twice and so on, up to CAP times: once may be chance where thrice is not.
HEADS, CAP = (4, 5, 6, 7), 3
#: Features need this share of P (and this many documents of it) and this many standard errors.
MIN_SHARE, MIN_DOCS, MIN_Z, MAX_FEATURES = 0.01, 4, 4.0, 1500
_words = re.compile(r"\w+").findall
_WORD = zlib.crc32(b"=")  # a whole word is hashed with this sign before it


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    raw = word.encode("utf-8")
    cut = raw if len(raw) == len(word) else word  # of ASCII words bytes can be cut
    heads = [cut[:k] for k in HEADS if len(word) >= k]
    return [zlib.crc32(raw, _WORD), *map(zlib.crc32, heads if cut is raw else [x.encode("utf-8") for x in heads])]


def level(feature: int, count: int) -> int:
    """The hash of `feature` being there `count` times at least."""
    return (feature + 0x9E3779B1 * (count - 1)) & 0xFFFFFFFF


def document_features(text: str | None) -> list[int]:
    found: Counter = Counter()
    for word, n in Counter(_words((text or "").lower())).items():
        for h in word_features(word):
            found[h] += n
    return [level(h, k) for h, n in found.items() for k in range(1, min(n, CAP) + 1)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sparse:
    """Rows of 0/1 features: the coordinates of the ones."""

    row: np.ndarray
    col: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], d)


def nnpu_fit(p: Sparse, u: Sparse, d: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the logistic loss, by Adam. Where
    the negative risk falls below -slack, the step goes up its slope instead of down."""
    theta = np.zeros(d + 1)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        zp, zu = p.dot(theta[:-1]) + theta[-1], u.dot(theta[:-1]) + theta[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_pos, gp_neg, gu_neg = -_sigmoid(-zp) / p.n, _sigmoid(zp) / p.n, _sigmoid(zu) / u.n
        gp, gu = (prior * (gp_pos - gp_neg), gu_neg) if negative >= -slack else (prior * gp_neg, -gu_neg)
        grad = np.append(p.back(gp, d) + u.back(gu, d) + decay * theta[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic fit of label on margin (Platt), by damped Newton steps."""
    if len(label) < 20 or label.min() == label.max():
        return 1.0, 0.0
    a, b = 1.0, 0.0
    soft = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(steps):
        q = _sigmoid(a * margin + b)
        g = np.array([((q - soft) * margin).mean(), (q - soft).mean()])
        h = q * (1 - q)
        hess = np.array([[(h * margin**2).mean(), (h * margin).mean()], [(h * margin).mean(), h.mean()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def matcher(features: np.ndarray) -> Callable[[str | None], np.ndarray]:
    """text → positions in the sorted `features` of those that the text has. Words are remembered with their places
    among the features' first levels, as bytes, so a text's are joined and counted without a loop over them."""
    step = lambda k: np.uint32(0x9E3779B1 * k & 0xFFFFFFFF)
    features = features.astype(np.uint32)
    roots = np.unique(np.concatenate([features - step(k) for k in range(CAP)]))
    place = {int(h): np.int32(k).tobytes() for k, h in enumerate(roots)}
    levels = np.full((len(roots), CAP), -1, np.int32)  # the position of being there k + 1 times, -1 for none
    for k in range(CAP if len(features) else 0):
        at = np.minimum(np.searchsorted(features, roots + step(k)), len(features) - 1)
        levels[:, k] = np.where(features[at] == roots + step(k), at, -1)
    known = BoundedTable(lambda word: b"".join([place[h] for h in word_features(word) if h in place]), 50_000)

    def find(text: str | None) -> np.ndarray:
        places = np.frombuffer(b"".join(map(known.__getitem__, _words((text or "").lower()))), np.int32)
        there, counts = np.unique(places, return_counts=True)
        found = levels[there]
        return np.sort(found[(found >= 0) & (np.arange(CAP) < counts[:, None])])

    return find


@dataclass
class ToxicModel:
    weights: dict[int, float]
    offset: float

    def scorer(self) -> Callable[[str | None], float]:
        names = sorted(self.weights)
        find, weights = matcher(np.array(names, np.uint32)), np.array([self.weights[h] for h in names], np.float64)
        return lambda text: float(_sigmoid(self.offset + weights[find(text)].sum()))


def _sample_features(docs: DataFrame, ids: DataFrame) -> list:
    """Feature hashes of the sampled documents; ids is bounded, so broadcast and collected."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [np.unique(np.array(document_features(t.as_py()), "<u4")).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "role", "toxic")), pa.array(hashes, pa.binary())], ["doc_id", "role", "toxic", "hashes"])

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = arrow_rows(picked, rows, "doc_id long, role int, toxic int, hashes binary")
    return found.groupBy("doc_id", "role", "toxic").agg(F.min("hashes").alias("hashes")).collect()


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the training fold, one row a document."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def feature_counts(docs: DataFrame, names: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different texts the training fold has, and how many of them have each feature of `names`. All
    its rows are read; only sums by feature, as many as names, come to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(names)  # features that MIN_SHARE of at most MAX_POSITIVE documents have

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                hits = [np.append(np.int32(-1), find(t.as_py())) for t in part.column("text")]  # -1: the text itself
                ends = np.cumsum([0, *map(len, hits)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(ends, np.concatenate(hits))], ["key", "hits"])

    fold = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = arrow_rows(fold.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text"), rows, "key long, hits array<int>")
    once = found.groupBy("key").agg(F.first("hits").alias("hits"))
    counted = once.select(F.explode("hits").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r.feature: r.n for r in counted}
    return total.get(-1, 0), np.array([total.get(k, 0) for k in range(len(names))], np.int64)


def supported(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features with enough support in P, sorted, and in how many of its documents each is."""
    names, in_p = np.unique(np.concatenate(hashes), return_counts=True)
    enough = in_p >= max(MIN_DOCS, MIN_SHARE * len(hashes))
    return names[enough], in_p[enough]


def choose(names: np.ndarray, in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Features that tell P from U, by z scores of the shares' difference."""
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(names[best[z[best] >= MIN_Z]])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicModel:
    known = training_labels(labels, "toxic")
    mean = known.agg(F.avg("label")).first()[0]
    if not mean:
        return ToxicModel({}, -35.0)
    by = F.xxhash64(F.lit(3), "doc_id")
    positive = known.where("label = 1").orderBy(by, "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("role"), F.lit(1).alias("toxic"))
    others = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(max_unlabelled)
    others = others.join(known, "doc_id", "left").select("doc_id", F.lit(0).alias("role"), F.col("label").alias("toxic"))
    rows = _sample_features(docs, positive.unionByName(others))
    texts = {(r.role, bytes(r.hashes)): r.toxic for r in sorted(rows, key=lambda r: (r.toxic is not None, r.toxic or 0))}  # copies count once
    role = np.array([k for k, _ in sorted(texts)])
    if not (role == 1).any() or not (role == 0).any():
        return ToxicModel({}, -35.0)
    toxic = np.array([-1 if texts[k] is None else texts[k] for k in sorted(texts)])
    hashes = [np.frombuffer(h, "<u4") for _, h in sorted(texts)]
    candidates, in_p = supported([h for h, r in zip(hashes, role, strict=True) if r == 1])
    n_u, in_u = feature_counts(docs, candidates)
    names = choose(candidates, in_p, int((role == 1).sum()), in_u, n_u)
    # of a document only the chosen features are held, so memory is that of one document's features
    found = [np.flatnonzero(np.isin(names, h, assume_unique=True)) for h in hashes]
    parts = []
    for k in (1, 0):
        mine = [f for f, r in zip(found, role, strict=True) if r == k]
        parts.append(Sparse(np.repeat(np.arange(len(mine)), [len(f) for f in mine]), np.concatenate([*mine, np.zeros(0, np.int64)]), len(mine)))
    w, b = nnpu_fit(*parts, len(names), float(mean))
    margins = parts[1].dot(w) + b
    told = toxic[role == 0]
    slope, offset = calibrate(margins[told >= 0], told[told >= 0])
    return ToxicModel({int(h): float(slope * x) for h, x in zip(names, w, strict=True) if abs(x) > 1e-6}, slope * b + offset)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([value(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, score double")


def accepted(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with a score under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value.scorer()
        for b in batches:
            yield b.filter(pa.array([value(t.as_py()) < threshold for t in b.column("text")], pa.bool_()))

    return arrow_rows(docs, rows, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
