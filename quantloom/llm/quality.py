"""Document quality by co-training a text view and a metadata view.

The text view sees what the characters and words look like; the metadata view sees language, source
and the page's layout numbers (length, lines, bytes per character). Each is a numpy logistic
regression. Over some rounds each classifier labels the unlabelled pool, and its most confident
documents join the other's training set as pseudo-labels. Last, each view is calibrated, and the
calibrated views are combined, on labelled rows that took no part in training.

Training rows are bounded: MAX_LABELLED labelled and MAX_POOL unlabelled documents, chosen by a hash of
the id from the training fold; a document costs some dozens of numbers. Every document is scored.

Defined results: null and empty texts are scored from the features of an empty text; null lang or
source is a value of its own; without both classes among the labels every score is the labels'
mean (1 without labels); null doc_ids are scored and not held out; repeated rows are scored
each; of the rows of a repeated doc_id one, with the least bytes of features, is trained on; of repeated labels the largest counts;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_rows, held_out, table
from quantloom.llm.toxicity import _sigmoid, calibrate, training_labels

MAX_LABELLED, MAX_POOL = 12_000, 24_000
THRESHOLD = 0.5
ROUNDS, PER_ROUND, SURE = 4, 0.05, 0.97
SOURCES = 64
_PUNCT = np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8)
N_TEXT, N_META = len(_PUNCT) + 14, 8 + 8 + SOURCES


def text_view(text: str) -> np.ndarray:
    """Shares of characters, words and lines of some looks; square roots spread the small ones."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    words = text.split()
    k = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:]))
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    loud = sum(w.isupper() for w in words)
    odd = sum(not w[-1].isalnum() for w in words)
    shares = [
        *(seen[_PUNCT] / n), upper / max(1, upper + lower), digits / n, seen[:32].sum() / n, seen[128:].sum() / n, again / k,
        1 - len(set(words)) / k, 1 - len(set(pairs)) / max(1, len(pairs)), loud / k, odd / k, 1 - len(set(lines)) / max(1, len(lines)),
        sum(w.isdigit() for w in words) / k, sum(len(w) > 20 for w in words) / k, min(1.0, n / k / 20), len(words) == 0,
    ]
    return np.sqrt(np.array(shares, np.float64))


def meta_view(lang: str | None, source: str | None, text: str) -> np.ndarray:
    n, raw, lines = len(text), len(text.encode("utf-8")), text.split("\n")
    longest = max(map(len, lines))
    layout = [np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines)), np.log1p(longest), raw / max(1, n), longest / max(1, n), sum(not x for x in lines) / len(lines), n < 50]
    out = np.zeros(N_META)
    out[:8] = layout
    out[8 + zlib.crc32((lang or "?").encode()) % 8] = 1
    out[16 + zlib.crc32((source or "?").encode()) % SOURCES] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-3, steps: int = 25) -> Logistic:
    """L2-regularised logistic regression by Newton steps on standardised features."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    theta = np.zeros(z.shape[1])
    ridge = np.full(len(theta), decay)
    ridge[-1] = 1e-9
    total = weight.sum()
    for _ in range(steps):
        q = _sigmoid(z @ theta)
        grad = z.T @ (weight * (q - y)) / total + ridge * theta
        h = (z * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ z / total + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, grad)
        theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, theta[:-1], float(theta[-1]))


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS) -> list[Logistic]:
    """One classifier a view. In each round each view's surest pool rows, in the labels' proportion of
    classes, go to the other view's training set at half weight; a row is given once."""
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in views]
    models = [fit_logistic(x, y) for x in views]
    n, share = len(pools[0]), y.mean()
    for _ in range(rounds if n else 0):
        new = []
        for k, model in enumerate(models):
            other = 1 - k
            p = _sigmoid(model.margin(pools[k]))
            p[given[other][0]] = np.nan
            good, bad = int(np.ceil(PER_ROUND * n * share)), int(np.ceil(PER_ROUND * n * (1 - share)))
            order = np.argsort(-p, kind="stable")
            order = order[~np.isnan(p[order])]
            top, low = order[:good], order[::-1][:bad]
            at = np.concatenate([top[p[top] >= SURE], low[p[low] <= 1 - SURE]])
            new.append((other, at, (p[at] >= 0.5).astype(float)))
        for other, at, label in new:
            given[other] = (np.concatenate([given[other][0], at]), np.concatenate([given[other][1], label]))
        models = [
            fit_logistic(np.vstack([x, pools[k][given[k][0]]]), np.append(y, given[k][1]), np.append(np.ones(len(y)), np.full(len(given[k][0]), 0.5)))
            for k, x in enumerate(views)
        ]
    return models


@dataclass
class QualityModel:
    views: list[Logistic]
    calibration: list[tuple[float, float]]
    mix: Logistic | None
    base: float

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.views:
            flat = np.full(len(text_x), self.base)
            return flat, flat, flat
        z = np.stack([a * m.margin(x) + b for m, (a, b), x in zip(self.views, self.calibration, (text_x, meta_x), strict=True)], 1)
        both = _sigmoid(self.mix.margin(np.clip(z, -12, 12))) if self.mix else _sigmoid(z.sum(1) - np.log(self.base / (1 - self.base)))
        return _sigmoid(z[:, 0]), _sigmoid(z[:, 1]), both


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, meta = np.empty((b.num_rows, N_TEXT)), np.empty((b.num_rows, N_META))
    for k, (t, lang, source) in enumerate(zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)):
        whole = t.as_py() or ""
        text[k], meta[k] = text_view(whole), meta_view(lang, source, whole)
    return text, meta


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> QualityModel:
    known = training_labels(labels, "quality")
    by = F.xxhash64(F.lit(5), "doc_id")
    told = known.orderBy(by, "doc_id").limit(max_labelled)
    pool = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(max_pool)
    ids = told.unionByName(pool.join(known, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("label")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = _views(b)
            packed = [np.concatenate(x).astype("<f4").tobytes() for x in zip(text, meta, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "x"])

    picked = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(ids), "doc_id")  # ids are bounded
    once = arrow_rows(picked, rows, "doc_id long, label int, x binary").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    got = sorted(once.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.x)))
    y = np.array([-1 if r.label is None else r.label for r in got])
    base = float(y[y >= 0].mean()) if (y >= 0).any() else 1.0
    if not 0 < base < 1:
        return QualityModel([], [], None, base)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), "<f4").reshape(len(got), -1).astype(np.float64)
    views = [x[:, :N_TEXT], x[:, N_TEXT:]]
    aside = (y >= 0) & (np.arange(len(y)) % 4 == 0)
    fit, free = (y >= 0) & ~aside, y < 0
    if len(set(y[fit])) < 2 or len(set(y[aside])) < 2:
        fit = aside = y >= 0
    models = co_train([v[fit] for v in views], y[fit].astype(float), [v[free] for v in views])
    margins = [m.margin(v[aside]) for m, v in zip(models, views, strict=True)]
    calibration = [calibrate(m, y[aside]) for m in margins]
    z = np.stack([a * m + b for m, (a, b) in zip(margins, calibration, strict=True)], 1)
    return QualityModel(models, calibration, fit_logistic(np.clip(z, -12, 12), y[aside].astype(float), decay=1e-2), base)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, p_text, p_meta, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = [pa.array(x) for x in sent.value.score(*_views(b))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", "p_text", "p_meta", "score"])

    return arrow_rows(docs.select("doc_id", "text", "lang", "source"), rows, "doc_id long, p_text double, p_meta double, score double")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(sent.value.score(*_views(b))[2] >= threshold))

    return arrow_rows(docs, rows, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
