"""The quality classifier: its parts against brute force, held-out accuracy, awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import quality


def test_awkward_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(140)] + [(None, 1, 0), (3, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    again = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in found:
        if len(texts[r.doc_id]) == 1:
            assert again.setdefault((r.doc_id, next(iter(texts[r.doc_id]))), r.score) == r.score
    assert quality.quality(none, labels).isEmpty()
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_moments_and_histograms(spark, docs):
    rows = quality.shapes(docs).select((F.xxhash64("levels") % 2 == 0).cast("int").alias("fold"), F.coalesce((F.col("doc_id") % 3 == 0).cast("int"), F.lit(0)).alias("positive"), "levels")
    found, data = quality.moments(rows), rows.collect()
    x = np.array([np.frombuffer(r.levels, dtype=np.uint8)[quality._AT] >= quality._LEVEL for r in data], dtype=float)
    for (fold, positive), m in found.items():
        own = x[[r.fold == fold and (r.positive == 1 or not positive) for r in data]]
        assert (m == own.T @ own).all()
    w = np.random.default_rng(1).normal(size=quality.FEATURES)
    middles, u, p = quality.histograms(rows, w, 1)
    mine = [r.fold == 1 for r in data]
    assert u.sum() == sum(mine) and p.sum() == sum(m and r.positive for m, r in zip(mine, data, strict=True))
    assert math.isclose((middles * u).sum(), (x[mine] @ w).sum(), rel_tol=0.02, abs_tol=0.02 * (middles[-1] - middles[0]))


def test_prior_of_a_mixture():
    """Two normal classes, 70 % good: the bound is near the truth."""
    rng = np.random.default_rng(4)
    edges = np.linspace(-8, 8, 400)
    unlabelled = np.histogram(np.where(rng.random(60_000) < 0.7, rng.normal(2, 1, 60_000), rng.normal(-2, 1, 60_000)), edges)[0]
    positive = np.histogram(rng.normal(2, 1, 20_000), edges)[0]
    assert abs(quality.class_prior(unlabelled, positive) - 0.7) < 0.03


def test_least_non_negative_risk():
    """No other weights have less risk, where it is the unbiased one's and where the bound holds."""
    rng = np.random.default_rng(5)

    def risk(w, p, u, prior, decay):
        pos = 0.25 * prior * (1 - 2 * w @ p[0] + w @ p @ w)
        neg = 0.25 * ((1 + 2 * w @ u[0] + w @ u @ w) - prior * (1 + 2 * w @ p[0] + w @ p @ w))
        return pos + max(0, neg) + decay * w[1:] @ w[1:]

    seen = set()
    for n_p, n_u, prior in ((400, 3000, 0.5), (12, 14, 0.9), (8, 9, 0.95)):
        x = lambda n, m: np.c_[np.ones(n), (rng.normal(m, 1, (n, 6)) > 0).astype(float)]
        good = x(n_p, 0.8)
        mixed = np.r_[x(int(n_u * prior), 0.8), x(n_u - int(n_u * prior), -0.8)]
        p, u = good.T @ good / len(good), mixed.T @ mixed / len(mixed)
        w, share = quality.minimise(p, u, prior, 1e-3)
        seen.add(share > 0)
        best = risk(w, p, u, prior, 1e-3)
        assert all(best <= risk(w + rng.normal(0, scale, len(w)), p, u, prior, 1e-3) + 1e-6 for scale in (0.001, 0.03, 0.3) for _ in range(300))
    assert seen == {False, True}


def auc(score, good):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    for s in np.unique(score):
        own = np.flatnonzero(score[order] == s)
        ranks[order[own]] = own.mean() + 1
    n, m = good.sum(), (~good).sum()
    return (ranks[good].sum() - n * (n + 1) / 2) / (n * m)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, size):
    path = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    found = quality.op12(spark, path).filter("held_out").join(labels, "doc_id").collect()
    score, good = np.array([r.score for r in found]), np.array([r.quality == 1 for r in found])
    predicted = np.array([r.predicted == 1 for r in found])
    assert auc(score, good) > 0.95
    assert predicted[good].mean() > 0.97 and predicted[~good].mean() < 0.35
