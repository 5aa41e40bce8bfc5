"""Quality classifier (operator 12) by positive-unlabelled learning.

A text is described by levels of its shape: shares of classes of characters and of two that
follow each other, word and line lengths, repeated words and lines. Documents that labels
trust to be good are the positives; all training-side documents, whatever labels say of them,
are the unlabelled. No document counts as a negative.

With the loss (1 - z)^2 / 4 and a linear z the risk on positives, the one on unlabelled
documents and the difference of both that stands for negatives are quadratic in the weights,
so they follow from first and second moments, which are summed over all documents in one
pass. The non-negative risk is the greater of two convex quadratics; its minimum lies at the
minimum of one or where both are alike, and bisection finds it. The class prior is the least
share of unlabelled documents beyond a threshold to that of positives there, on other
documents than the ones the threshold's direction comes from. Two numbers, fitted to the
same risk with the logistic loss, make z a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, shuffle_parts, slices, table
from corroborate.llm.toxicity import held_out

#: Classes of bytes: a-z, A-Z, 0-9, space, line end, marks of sentences, other marks, beyond ASCII, control.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, WIDE, CONTROL = range(9)
CLASSES = 9
_CLASS = np.full(256, CONTROL, dtype=np.uint8)
_CLASS[33:127] = MARK
for _chars, _kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (range(128, 256), WIDE), (b" \t", SPACE), (b"\n\r", LINE), (b".,;:'\"?-", STOP)):
    _CLASS[list(_chars)] = _kind
#: Levels of a share of bytes, of a share of two that follow each other, of a ratio, and of a length.
SHARES = np.array([0.0005, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6])
PAIRS = np.array([0.0002, 0.005, 0.02, 0.08])
RATIOS = np.array([0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
LENGTHS = np.array([1, 2, 3, 4, 6, 9, 14, 30, 100, 400, 1500, 6000])
#: Ratios and lengths of a text, as of shape().
N_RATIOS, N_LENGTHS = 6, 4
CODES = CLASSES + CLASSES * CLASSES + N_RATIOS + N_LENGTHS
_MOST = [len(SHARES)] * CLASSES + [len(PAIRS)] * CLASSES**2 + [len(RATIOS)] * N_RATIOS + [len(LENGTHS)] * N_LENGTHS
#: Column k of a row's features: whether the code at _AT[k] is _LEVEL[k] or more. The first is always 1.
_AT = np.array([0, *(at for at, most in enumerate(_MOST) for _ in range(most))])
_LEVEL = np.array([0, *(level for most in _MOST for level in range(1, most + 1))], dtype=np.uint8)
FEATURES = len(_AT)
#: Weight decay, bins of a histogram of z, the slack and the confidence of the prior's bound.
DECAY, BINS, SLACK, CONFIDENCE = 2e-3, 4096, 0.01, 0.1
#: Documents that are turned into features at once.
ROWS = 2000


def shape(text: str) -> np.ndarray:
    """The levels of one text, a byte each."""
    raw = text.encode()
    n = max(1, len(raw))
    classes = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    shares = np.bincount(classes, minlength=CLASSES) / n
    pairs = np.bincount(classes[:-1] * np.uint8(CLASSES) + classes[1:], minlength=CLASSES**2) / n
    words, lines = text.split(), text.split("\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    distinct = set(words)
    ratios = (
        len(distinct) / n_words, sum(map(eq, words, words[1:])) / n_words, len(set(lines)) / n_lines,
        sum(map(eq, words, words[2:])) / n_words, min(len(set(raw)), 100) / 100, len(set(words[:200])) / min(n_words, 200),
    )
    lengths = (len(raw) / n_words, n_words / n_lines, len(raw), max(map(len, distinct), default=0))
    levels = (np.searchsorted(SHARES, shares), np.searchsorted(PAIRS, pairs), np.searchsorted(RATIOS, ratios), np.searchsorted(LENGTHS, lengths))
    return np.concatenate(levels).astype(np.uint8)


def shapes(docs: DataFrame) -> DataFrame:
    """doc_id and levels of every row of ``docs`` (doc_id, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shape(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "levels"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, "doc_id long, levels binary")


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of 0 and 1, some thousands at a time."""
    for at in range(0, len(column), ROWS):
        rows = column.slice(at, ROWS).to_pylist()
        codes = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), CODES)
        yield (codes[:, _AT] >= _LEVEL).astype(np.float32)


def moments(training: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums of the products of each two features over ``training`` (fold, positive, levels), for each fold and for unlabelled (0) and positive (1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for n, x in enumerate(_features(batch.column(2))):
                own = keys[n * ROWS : n * ROWS + len(x)]
                for fold in (0, 1):
                    for positive in (0, 1):
                        chosen = x[(own[:, 0] == fold) & ((own[:, 1] == 1) | (positive == 0))]
                        if len(chosen):
                            held = sums.setdefault((fold, positive), np.zeros((FEATURES, FEATURES)))
                            held += chosen.T @ chosen  # below 2^24, so exact
        rows = [(fold, positive, k, row.astype("<i8").tobytes()) for (fold, positive), m in sums.items() for k, row in enumerate(m)]
        made = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in made[:3]), pa.array(made[3], pa.binary())], names=["fold", "positive", "k", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(FEATURES, dtype=np.int64)
        for batch in batches:
            for fold, positive, k, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (fold, positive, k) != key:
                    if key:
                        yield out(key, total)
                    key, total = (fold, positive, k), np.zeros(FEATURES, dtype=np.int64)
                total += np.frombuffer(sums, dtype="<i8")
        if key:
            yield out(key, total)

    def out(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([total.tobytes()], pa.binary())], names=["fold", "positive", "k", "sums"])

    schema = "fold int, positive int, k int, sums binary"
    parts = training.select("fold", "positive", "levels").mapInArrow(run, schema)
    summed = parts.repartition(shuffle_parts(training.sparkSession), "fold", "positive", "k").sortWithinPartitions("fold", "positive", "k").mapInArrow(add, schema)
    found = {(fold, positive): np.zeros((FEATURES, FEATURES)) for fold in (0, 1) for positive in (0, 1)}
    for r in summed.toLocalIterator():  # FEATURES rows for each fold and kind
        found[r["fold"], r["positive"]][r["k"]] = np.frombuffer(r["sums"], dtype="<i8")
    return found


def histograms(training: DataFrame, weights: np.ndarray, fold: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middles of bins of z, and how many unlabelled and positive rows of the fold (or both) are in each."""
    low, high = _range(weights)
    w = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            positive = batch.column(0).to_numpy() == 1
            for n, x in enumerate(_features(batch.column(1))):
                bins = np.clip(((x @ w - low) * (BINS / (high - low))).astype(np.int64), 0, BINS - 1)
                total[0] += np.bincount(bins, minlength=BINS)
                total[1] += np.bincount(bins[positive[n * ROWS : n * ROWS + len(x)]], minlength=BINS)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["cell", "n"])

    rows = training if fold is None else training.filter(F.col("fold") == fold)
    found = np.zeros(2 * BINS)
    for r in rows.select("positive", "levels").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        found[r["cell"]] = r["n"]
    return low + (np.arange(BINS) + 0.5) * (high - low) / BINS, found[:BINS], found[BINS:]


def _range(weights: np.ndarray) -> tuple[float, float]:
    """Bounds of z: levels of one code are reached in order, so the least and greatest running sum of each."""
    low = high = float(weights[0])
    for at in range(CODES):
        sums = np.cumsum(weights[1:][_AT[1:] == at])
        low, high = low + min(0.0, sums.min()), high + max(0.0, sums.max())
    return low, max(high, low + 1e-6)


def class_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of good documents, from histograms of a score that is higher for these.

    Beyond any threshold there are at least so many good ones among the unlabelled as the prior times the positives'
    share says; so the ratio of both shares bounds it, and is it where no bad ones are left. Of all thresholds the one with the
    least bound, once what chance may do is added, decides.
    """
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return 0.5
    beyond_u, beyond_p = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (unlabelled, positive))
    chance = math.sqrt(math.log(4 / CONFIDENCE) / (2 * n_u)) + math.sqrt(math.log(4 / CONFIDENCE) / (2 * n_p))
    some = beyond_p > 0
    ratio = beyond_u[some] / beyond_p[some]
    best = int((ratio + (1 + SLACK) * chance / beyond_p[some]).argmin())
    return float(np.clip(ratio[best], 0.02, 0.98))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights of the least non-negative risk, and the share of the first quadratic in the system they solve (0: the unbiased risk's own minimum).

    Both arguments are mean products of features, the first of which is 1. The risk is prior * P+ + max(0, U- - prior * P-).
    """
    p, u = positive[0], unlabelled[0]
    keep = 4 * decay * np.eye(len(p))
    keep[0, 0] = 1e-9

    def at(share: float) -> np.ndarray:
        return np.linalg.solve(share * prior * positive + (1 - share) * unlabelled + keep, share * prior * p + (1 - share) * (2 * prior * p - u))

    def of_negatives(w: np.ndarray) -> float:
        return 0.25 * ((1 + 2 * w @ u + w @ unlabelled @ w) - prior * (1 + 2 * w @ p + w @ positive @ w))

    w = at(0.0)
    if of_negatives(w) >= 0:
        return w, 0.0
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        if of_negatives(at(middle)) < 0:
            low = middle
        else:
            high = middle
    return at(high), high


def calibrated(middles: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift that make z a probability: the least logistic risk of positives and unlabelled rows, by Newton's steps."""
    u, p = unlabelled / max(1, unlabelled.sum()), positive / max(1, positive.sum())
    rows, at = np.stack([middles, np.ones_like(middles)]), np.array([1.0, 0.0])
    keep = np.array([2e-4, 1e-6])
    risk = lambda v: float(u @ np.logaddexp(0, v @ rows) - prior * p @ (v @ rows) + keep @ (v * v))
    for _ in range(200):
        s = 1 / (1 + np.exp(-np.clip(at @ rows, -60, 60)))
        slope = rows @ (u * s - prior * p) + 2 * keep * at
        step = np.linalg.solve((rows * (u * s * (1 - s))) @ rows.T + np.diag(2 * keep), slope)
        size, now = 1.0, risk(at)
        while size > 1e-6 and risk(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (2.0, 0.0)


class Classifier:
    """Weights of features, the class prior, and what makes z a probability."""

    def __init__(self, weights: np.ndarray, prior: float, scale: float, shift: float):
        self.weights, self.prior, self.scale, self.shift = weights, prior, scale, shift

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (features @ self.weights) + self.shift, -60, 60)))


def fit(shaped: DataFrame, labels: DataFrame) -> Classifier:
    """Train on rows of ``shaped`` (doc_id, levels; at rest) that are not held out.

    Positives are those that ``labels`` (doc_id, quality) marks 1 and nothing else. A doc_id that repeats with equal
    levels counts once. Without positives every text scores 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    trusted = known.agg(F.min(F.coalesce("quality", F.lit(0)) == 1).alias("good")).filter("good").select("doc_id", F.lit(1).alias("positive"))
    once = shaped.filter(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id", "levels"])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    training = checkpointed(once.join(trusted, "doc_id", "left").select(fold.alias("fold"), F.coalesce("positive", F.lit(0)).alias("positive"), "levels"))
    found = moments(training)
    counts = {key: m[0, 0] for key, m in found.items()}
    if not counts[0, 1] + counts[1, 1]:
        return Classifier(np.zeros(FEATURES), 0.5, 1.0, 0.0)
    mean = lambda *keys: sum(found[k] for k in keys) / max(1.0, sum(counts[k] for k in keys))
    # What tells positives from unlabelled rows of one fold points where good ones are; the other fold gives the prior, and each the other's.
    priors = []
    for fold_of in (0, 1):
        if counts[fold_of, 1] and counts[1 - fold_of, 1]:
            p, u = mean((fold_of, 1)), mean((fold_of, 0))
            keep = np.eye(FEATURES) * max(DECAY, 2 / counts[fold_of, 1])
            direction = np.linalg.solve(u - np.outer(u[0], u[0]) + keep, p[0] - u[0])
            priors.append(class_prior(*histograms(training, direction / max(1e-12, np.abs(direction).max()), 1 - fold_of)[1:]))
    prior = float(np.mean(priors)) if priors else 0.5
    weights, _ = minimise(mean((0, 1), (1, 1)), mean((0, 0), (1, 0)), prior, max(DECAY, 1 / (counts[0, 1] + counts[1, 1])))
    middles, u, p = histograms(training, weights)
    return Classifier(weights, prior, *calibrated(middles, u, p, prior))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, score (0 to 1, higher: better) and predicted, from the text alone.

    A null text scores as an empty one; rows may repeat and get equal scores; null ids stay null; other columns are
    not read; an empty table gives an empty result.
    """
    shaped = checkpointed(shapes(docs))
    classifier = fit(shaped, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(x) for x in _features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    scored = shaped.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
