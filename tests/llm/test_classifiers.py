"""Toxicity and quality classifiers: held-out accuracy, the risk estimator, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def labelled(spark, frame, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    rows = frame.where("held_out").join(labels, "doc_id").collect()
    y, p = np.array([r[column] for r in rows]), np.array([r.predicted for r in rows])
    return y, p


def test_toxicity_held_out(spark):
    got = toxicity.op3_toxicity(spark, SF).cache()
    assert got.count() == 10_000 and got.where("score < 0 or score > 1 or score is null").count() == 0
    y, p = labelled(spark, got, "toxic")
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.85 and y[p == 1].mean() > 0.9


def test_quality_held_out(spark):
    got = quality.op10_quality(spark, SF).cache()
    assert got.count() == 10_000
    y, p = labelled(spark, got, "quality")
    assert (y == p).mean() > 0.98 and p[y == 1].mean() > 0.99


def plain_features(text):
    """By word: each word and its beginnings, for being there once, twice, thrice."""
    times = Counter()
    for word in toxicity._words((text or "").lower()):
        for name in {f"={word}", *(word[:k] for k in (4, 5, 6, 7) if len(word) >= k)}:
            times[zlib.crc32(name.encode())] += 1
    return {(h + 0x9E3779B1 * k) % 2**32 for h, n in times.items() for k in range(min(n, 3))}


def test_scores_equal_a_plain_fit(spark):
    """Everything again by sets and a dense matrix on the small tables, where the sample is the whole fold."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = {r.doc_id: r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    told = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.toxic is not None}
    assert len(fold) <= toxicity.MAX_UNLABELLED and sum(told.values()) <= toxicity.MAX_POSITIVE
    prior = sum(told.values()) / len(told)
    sets = {t: frozenset(plain_features(t)) for t in set(fold.values())}
    p = sorted({tuple(sorted(sets[fold[d]])) for d, t in told.items() if t == 1 and d in fold})
    u = sorted({tuple(sorted(s)) for s in sets.values()})
    in_p, in_u = Counter(h for s in p for h in s), Counter(h for s in sets.values() for h in s)
    n, m, z = len(p), len(sets), {}
    for h, k in in_p.items():
        if k >= max(4, 0.01 * n):
            share = (k + in_u[h] + 1) / (n + m + 2)
            z[h] = (k / n - in_u[h] / m) / (share * (1 - share) * (1 / n + 1 / m)) ** 0.5
    names = sorted(sorted((h for h in z if z[h] >= 4), key=lambda h: (-z[h], h))[:1500])
    xp, xu = (np.array([[float(h in s) for h in names] for s in map(set, rows)]) for rows in (p, u))
    theta, one, two = np.zeros(len(names) + 1), 0.0, 0.0
    xp1, xu1 = (np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu))
    sigma = lambda t: 1 / (1 + np.exp(-t))
    for t in range(1, 301):
        zp, zu = xp1 @ theta, xu1 @ theta
        up = prior * -(xp1 * sigma(-zp)[:, None]).mean(0)
        neg = (xu1 * sigma(zu)[:, None]).mean(0) - prior * (xp1 * sigma(zp)[:, None]).mean(0)
        g = up + neg if np.log1p(np.exp(zu)).mean() >= prior * np.log1p(np.exp(zp)).mean() else -neg
        g = g + 1e-3 * np.append(theta[:-1], 0)
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        theta = theta - 0.05 * one / (1 - 0.9**t) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    model = toxicity.train(docs, labels)
    weights = dict(zip(names, theta, strict=False))
    slope = np.median([model.weights[h] / w for h, w in weights.items() if h in model.weights and abs(w) > 0.1])
    assert set(model.weights) <= set(names) and len(model.weights) > 20 and slope > 0
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    shift = model.offset - slope * theta[-1]
    for r in docs.collect():
        margin = theta[-1] + sum(weights.get(h, 0.0) for h in plain_features(r.text))
        assert got[r.doc_id] == pytest.approx(sigma(slope * margin + shift), abs=1e-3)


def test_features_are_counted_over_all_texts(spark):
    rows = [(k, f"aa bb{k % 3} bb{k % 3}") for k in range(300)] + [(k, "aa aa cc") for k in range(300, 600)] + [(700, None), (None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = np.array(sorted({h for _, t in rows for h in plain_features(t)}), np.uint32)
    texts = {t or "" for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 4 != 2}
    n, found = toxicity.feature_counts(docs, names)
    assert n == len(texts) and found.tolist() == [sum(h in plain_features(t) for t in texts) for h in names.tolist()]


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("vile word "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    ids = spark.createDataFrame([(1, 1, 1)], "doc_id long, role int, toxic int")
    assert len(toxicity._sample_features(docs, ids)) == 1
    told = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, told)).count() == quality.score(docs, quality.train(docs, told)).count() == 20_000


def test_non_negative_risk_keeps_hidden_positives():
    """Most of U's toxic rows are unlabelled; the fit still ranks them above the others."""
    rnd = np.random.default_rng(1)
    p = toxicity.Sparse(np.arange(50), np.zeros(50, np.int64), 50)
    hidden = np.arange(60)  # of 600 rows, 60 have the toxic feature too
    noise = rnd.integers(1, 40, 600)
    u = toxicity.Sparse(np.concatenate([hidden, np.arange(600)]), np.concatenate([np.zeros(60, np.int64), noise]), 600)
    w, b = toxicity.nnpu_fit(p, u, 40, 0.1)
    assert w[0] > 2 and (u.dot(w) + b)[:60].min() > (u.dot(w) + b)[60:].max()


def test_risk_gradient_by_differences():
    p, u = toxicity.Sparse(np.array([0, 1]), np.array([0, 1]), 2), toxicity.Sparse(np.array([0, 1, 2]), np.array([1, 1, 0]), 3)
    w, b = toxicity.nnpu_fit(p, u, 2, 0.3, steps=400, rate=0.02, decay=0)

    def risk(w, b):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        return 0.3 * np.logaddexp(0, -zp).mean() + max(0, np.logaddexp(0, zu).mean() - 0.3 * np.logaddexp(0, zp).mean())

    assert risk(w, b) < risk(np.zeros(2), 0.0)


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (None, None, None, None), (2, "", "en", None), (2, "x " * 300_000, "en", "s")], "doc_id long, text string, lang string, source string").selectExpr("*", "1.5 as score")
    for labels in ([], [(1, None, None)], [(1, 1, 1), (1, 0, 0), (None, 1, 1)]):
        told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        bad, good = toxicity.train(docs, told), quality.train(docs, told)
        assert toxicity.score(docs, bad).count() == 4 and quality.score(docs, good).count() == 4
        kept = toxicity.accepted(docs, bad)
        assert kept.columns == docs.columns and quality.accepted(docs, good).columns == docs.columns
        assert toxicity.score(docs.limit(0), bad).collect() == [] and quality.score(docs.limit(0), good).collect() == []
    empty = toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert empty.weights == {}


def test_scores_read_texts_alone(spark):
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    a = spark.createDataFrame([(1, "some idiot text", "en", "s1")], "doc_id long, text string, lang string, source string")
    b = spark.createDataFrame([(2, "some idiot text", "de", "s2")], "doc_id long, text string, lang string, source string")
    assert toxicity.score(a, model).first().score == toxicity.score(b, model).first().score


def test_co_training_uses_the_pool():
    rnd = np.random.default_rng(3)
    n = 4000
    y = rnd.integers(0, 2, n).astype(float)
    views = [y[:, None] + rnd.normal(0, 0.35, (n, 3)), y[:, None] + rnd.normal(0, 0.35, (n, 3))]
    told = np.arange(n) < 12
    alone = quality.fit_logistic(views[0][told], y[told])
    both = quality.co_train([v[told] for v in views], y[told], [v[~told] for v in views])
    right = lambda m: ((m.margin(views[0][~told]) > 0) == (y[~told] == 1)).mean()
    assert right(both[0]) >= right(alone)


@pytest.mark.parametrize("seed", [1, 2])
def test_calibration_improves_log_loss(seed):
    rnd = random.Random(seed)
    margin = np.array([rnd.gauss(0, 2) for _ in range(2000)])
    label = np.array([int(rnd.random() < 1 / (1 + np.exp(-(0.5 * m - 1)))) for m in margin])
    a, b = toxicity.calibrate(margin, label)
    assert abs(a - 0.5) < 0.15 and abs(b + 1) < 0.25
