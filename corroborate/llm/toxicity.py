"""Toxicity (operator 1) by weak supervision.

Some dozens of voters, lexicons and patterns, fire on a text or do not. A generative label
model says how often each fires on toxic and on clean texts and how far voters repeat each
other, and it is estimated from how often voters fire together on all training-side
documents, labelled or not. Its posteriors are what a linear classifier on the presence of
words and word beginnings is trained on. Labels choose the words of lexicons, say which way
toxic is and how common it is; they are no votes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, fresh, hinted, slices, table

#: Labelled rows that lexicons and the classifier are fitted on, at most: those with the least hash.
FIT_ROWS = 20_000
#: Words and word beginnings that the classifier may use, and lengths of the beginnings (0: the whole word).
FEATURES, LENGTHS = 4096, (0, 4, 5, 6, 7)
#: Lexicons, words in all of them, and what the log odds of these are above for sure (by so many standard errors).
LEXICONS, LEXICON_WORDS, LEAST_ODDS, ERRORS = 24, 200, 1.0, 1.5
#: Words of a text for each that a lexicon must hit.
WORDS_A_HIT = 500
#: Insults that count as toxic in any corpus.
INSULTS = "asshole bastard bitch crap cretin damn disgusting dumb dumbass filth filthy freak garbage hate idiot idiotic imbecile jerk loser moron moronic pathetic pig retard scum scumbag shit shut slut stupid sucker trash ugly vermin whore worthless"
#: Patterns that lean to toxic: second person with an insult's opening, masked profanity, shouting, strings of marks, threats, curses;
#: and characters without which they cannot match (lower-cased text is searched for them first).
PATTERNS = (
    (r"\b(?:you|u|your?)(?:'?re| are)? (?:such )?an? [^\W\d_]+[!.]", ("you", "u")),
    (r"\b[a-z]{1,3}[*#@$%]{2,}[a-z]*\b", ("**", "##", "@@", "$$", "%%", "*#", "#@", "@$", "$%")),
    (r"[A-Z\u00C0-\u00DE][A-Z\u00C0-\u00DE]{3,}\b\W+(?:[A-Z\u00C0-\u00DE]{4,}\b\W+){3,}", ()),
    (r"[!?]{3,}", ("!", "?")),
    (r"(?i)\b(?:kill|hurt|destroy|hate) (?:you|them|him|her)\b", ("kill ", "hurt ", "destroy ", "hate ")),
    (r"(?i)\bgo to hell\b|\bshut up\b|\bscrew you\b", ("go to hell", "shut up", "screw you")),
)
#: The within-class correlation from which two voters are said to repeat each other.
EDGE = 0.1
#: Words whose features a worker remembers, and as many that have none.
WORDS_KEPT = 50_000

_WORD = re.compile(r"[^\W\d_]+")
_INSULTS = frozenset(INSULTS.split())
_PATTERNS = tuple((re.compile(p), needs) for p, needs in PATTERNS)


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from training: crc32(doc_id as text) mod 5 is 0. A null id reads as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def features_of(text: str) -> set[str]:
    """Words, lower-cased, and their beginnings, marked with their length."""
    words = set(_WORD.findall(text.lower()))
    return {w if not n else f"{w[:n]}-" for n in LENGTHS for w in words if len(w) > n}


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, n, toxic): rows of ``sample`` (toxic, text) with each feature, and toxic ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            n = [seen[0][f] + seen[1][f] for f in names]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], names=["feature", "n", "toxic"])

        for batch in slices(batches, 1):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(features_of(text))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
                seen[0].clear()
                seen[1].clear()
        yield out()

    counts = sample.select("toxic", "text").mapInArrow(run, "feature string, n long, toxic long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


class Vocabulary:
    """The features in use, and the voters made of them.

    ``features``: each with the least that its log odds are likely to be. Those that most surely
    lean to toxic are dealt to lexicons by their hash, so each lexicon holds words of all kinds.
    """

    def __init__(self, features: list[tuple[str, float]]):
        ranked = sorted((-least, f) for f, least in features if least >= LEAST_ODDS)
        chosen = {f for _, f in ranked[:LEXICON_WORDS]}
        self.number = {f: i for i, (f, _) in enumerate(features)}
        self.lexicon = [zlib.crc32(f.rstrip("-").encode()) % LEXICONS if f in chosen else LEXICONS for f, _ in features]
        self.known: dict[str, tuple[int, ...]] = {}
        self.plain: set[str] = set()

    def words(self, text: str) -> set[str]:
        return set(_WORD.findall(text.lower()))

    def numbers(self, words: set[str]) -> list[int]:
        """Numbers of the features that some words have; most words have none and are soon known for it."""
        found: set[int] = set()
        for w in words.difference(self.plain):
            own = self.known.get(w)
            if own is None:
                own = tuple(self.number[f] for f in (w, *(f"{w[:n]}-" for n in LENGTHS[1:] if len(w) > n)) if f in self.number)
                if not own:
                    self.plain.add(w)
                    continue
                self.known[w] = own
            found.update(own)
        for kept in (self.plain, self.known):
            if len(kept) > WORDS_KEPT:
                kept.clear()
        return sorted(found)

    def votes(self, text: str, words: set[str], numbers: list[int]) -> list[int]:
        """1 for each voter that fires."""
        hits = [0] * (LEXICONS + 1)
        for i in numbers:
            hits[self.lexicon[i]] += 1
        needed = 1 + len(words) // WORDS_A_HIT
        insults, low = len(words & _INSULTS), text.lower()
        found = [int((not needs or any(n in low for n in needs)) and p.search(text) is not None) for p, needs in _PATTERNS]
        return [*(int(h >= needed) for h in hits[:-1]), *(int(insults >= n) for n in (1, 2, 4)), *found]


VOTERS = LEXICONS + 3 + len(PATTERNS)


def agreements(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """How many rows of ``texts`` (text) each two voters fire on together; in the last row and column: each alone, and all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOTERS + 1, VOTERS + 1))
        for batch in slices(batches, 0):
            rows = []
            for text in batch.column(0).to_pylist():
                own = words.words(text)
                rows.append([*words.votes(text, own, words.numbers(own)), 1])
            if rows:
                fired = np.array(rows, dtype=np.float64)
                total += fired.T @ fired
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    cells = texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((VOTERS + 1) ** 2)
    for r in cells.collect():  # one row for each two voters
        out[r["cell"]] = r["n"]
    return out.reshape(VOTERS + 1, VOTERS + 1)


class LabelModel:
    """Voters that fire at their own rates on toxic and clean texts, and repeat each other within the classes.

    Whatever the classes explain of how two voters fire together is a product of what each knows
    of the class, so one factor is fitted to all pairs of voters. The pair that it leaves the
    most correlation, EDGE or more, is taken out, as voters that repeat each other, and it is
    fitted again, until none is left. A voter's log odds count less the more others repeat it: weights w solve
    R w = 1 for the within-class correlations R, so two copies count a half each.
    """

    def __init__(self, counts: np.ndarray, prior: float, polarity: np.ndarray | None = None):
        """``counts`` as of agreements(), ``prior``: share of toxic texts, ``polarity``: -1 for voters that lean to clean, else 1."""
        polarity = np.ones(len(counts) - 1) if polarity is None else polarity
        n = max(counts[-1, -1], 1.0)
        mean = counts[-1, :-1] / n
        cov = counts[:-1, :-1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        live = sd > 0
        corr = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(live, live))
        np.fill_diagonal(corr, 0)
        self.prior = prior = min(0.5, max(1e-3, prior))
        free = np.outer(live, live) & ~np.eye(len(mean), dtype=bool)
        factor = self._factor(corr, free, polarity)
        # One pair at a time, while each voter keeps the half of the others.
        least = max(2, (int(live.sum()) - 1) // 2)
        while True:
            kept = free.sum(axis=1) > least
            left = np.abs(self._within(corr, factor)) * (free & np.outer(kept, kept))
            a, b = np.unravel_index(int(left.argmax()), left.shape)
            if left[a, b] < EDGE:
                break
            free[a, b] = free[b, a] = False
            factor = self._factor(corr, free, polarity)
        apart = factor * sd / math.sqrt(prior * (1 - prior))  # rate on toxic less rate on clean texts
        tiny = 0.5 / n
        #: Rates of firing on toxic and on clean texts.
        self.rates = np.clip(np.stack([mean + (1 - prior) * apart, mean - prior * apart]), tiny, 1 - tiny)
        #: Correlations within the classes.
        self.correlations = np.where(free | ~np.outer(live, live), 0, self._within(corr, factor))
        np.fill_diagonal(self.correlations, 1)
        repeats = np.where(np.eye(len(mean), dtype=bool), 1.0, np.maximum(self.correlations, 0))
        self.scale, self.shift = 1.0, 0.0
        self.weight = np.clip(np.linalg.lstsq(repeats, np.ones(len(mean)), rcond=None)[0], 0.02, 1) * live

    @staticmethod
    def _factor(corr: np.ndarray, free: np.ndarray, polarity: np.ndarray) -> np.ndarray:
        """g with g_i g_j nearest to the correlations of the free pairs."""
        g = np.abs(np.where(free, corr, 0)).mean(axis=1) ** 0.5 * polarity
        for _ in range(500):
            squares = free @ (g * g)
            new = np.divide(np.where(free, corr, 0) @ g, squares, out=np.zeros_like(g), where=squares > 1e-12)
            new = np.clip(0.5 * g + 0.5 * new, -0.995, 0.995)
            if np.abs(new - g).max() < 1e-9:
                break
            g = new
        return g if g @ polarity >= 0 else -g

    @staticmethod
    def _within(corr: np.ndarray, factor: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(1 - factor * factor, 1e-3))
        left = (corr - np.outer(factor, factor)) / np.outer(rest, rest)
        np.fill_diagonal(left, 0)
        return np.clip(left, -1, 1)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic for each row of 0s and 1s."""
        fires, rests = np.log(self.rates[0] / self.rates[1]), np.log((1 - self.rates[0]) / (1 - self.rates[1]))
        return votes @ ((fires - rests) * self.weight) + (rests * self.weight).sum() + math.log(self.prior / (1 - self.prior))

    def calibrate(self, log_odds: np.ndarray, toxic: np.ndarray) -> None:
        """Scale and shift the log odds to what labels say of them: two numbers, by Newton's steps on smoothed targets."""
        hits = toxic.sum()
        target = np.where(toxic, (hits + 1) / (hits + 2), 1 / (len(toxic) - hits + 2))
        rows, at = np.stack([log_odds, np.ones_like(log_odds)]), np.array([1.0, 0.0])
        for _ in range(50):
            p = _logistic(at @ rows)
            slope = rows @ (p - target) + 1e-3 * (at - [1, 0])
            step = np.linalg.solve((rows * (p * (1 - p))) @ rows.T + 1e-3 * np.eye(2), slope)
            at = at - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if at[0] > 0:
            self.scale, self.shift = float(at[0]), float(at[1])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _logistic(self.scale * self.log_odds(votes) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _observed(sample: DataFrame, words: Vocabulary, model: LabelModel) -> DataFrame:
    """(toxic, numbers, z): the label of each row of ``sample`` (toxic, text), its features, and the log odds of its votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            numbers, votes = [], []
            for text in batch.column(1).to_pylist():
                own = words.words(text)
                numbers.append(words.numbers(own))
                votes.append(words.votes(text, own, numbers[-1]))
            z = model.log_odds(np.array(votes, dtype=float).reshape(-1, VOTERS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.list_(pa.int32())), pa.array(z)], names=["toxic", "numbers", "z"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, numbers array<int>, z double")


class Classifier:
    """What scores need: the features' numbers and weights."""

    def __init__(self, words: Vocabulary, weights: list[float], bias: float, label_model: LabelModel | None):
        self.words, self.weights, self.bias, self.label_model = words, weights, bias, label_model

    def score(self, text: str) -> float:
        z = self.bias + sum([self.weights[i] for i in self.words.numbers(self.words.words(text))])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Train on ``docs`` (doc_id, text; a null text is empty) that are not held out.

    The label model sees all of them. Lexicons and the classifier are fitted on at most ``rows``
    of those that ``labels`` (doc_id, toxic 0/1) names, with the least hash of doc_id; the
    classifier on the model's posteriors. Without labelled rows, or with one class alone, only
    the fixed lexicon decides. Rows may repeat: a text counts once for its doc_id, and at most
    ``rows`` texts in all, those with the least hash of both; other columns are not read.
    """
    # Workers import this module, too, and need nothing of this.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # A few hundred kilobytes: ``rows`` bounds it.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).filter(~held_out(F.col("doc_id")))
    # A doc_id may have many rows: equal ones count once, and ``rows`` bounds the others, too.
    keyed = texts.withColumn("th", F.xxhash64("text"))
    told = keyed.join(F.broadcast(chosen), "doc_id").select("doc_id", "th", "toxic").distinct().orderBy(F.xxhash64("doc_id", "th"), "doc_id", "th").limit(rows)
    sample = keyed.join(F.broadcast(told), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("toxic", "text").persist()
    try:
        n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < toxic < n:
            words = Vocabulary([(w, 5.0) for w in sorted(_INSULTS)])
            return Classifier(words, [4.0] * len(_INSULTS), -4.0, None)
        # Features by how much they tell: log odds with half a row added, weighted by the root of their rows.
        odds = F.log((F.col("toxic") + 0.5) / (F.lit(float(toxic)) + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (F.lit(float(n - toxic)) + 1))
        ranked = feature_counts(sample).filter("n >= 3").withColumn("odds", odds)
        surely = F.col("odds") - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("n") - F.col("toxic") + 0.5))
        best = ranked.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "feature").limit(FEATURES).select("feature", surely.alias("least")).collect()
        words = Vocabulary([(r["feature"], r["least"]) for r in best])
        model = LabelModel(agreements(texts, words), toxic / n)
        seen = _observed(sample, words, model).persist()
        said = np.array(seen.select("z", "toxic").collect())  # ``rows`` bounds it
        model.calibrate(said[:, 0], said[:, 1] == 1)
        p = 1 / (1 + F.exp(-(F.col("z") * model.scale + model.shift)))
        each = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), p.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - p).alias("weight"))))
        pairs = seen.select(F.col("numbers").cast("array<string>").alias("numbers"), each.alias("y")).select("numbers", "y.label", "y.weight").filter("weight > 0.001")
        vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(max(1, len(best)))], inputCol="numbers", outputCol="features")
        data = vectors.transform(pairs).select("features", "label", "weight").persist()
        try:
            fitted = LogisticRegression(weightCol="weight", regParam=2e-4, maxIter=80, standardization=False).fit(data)
        finally:
            data.unpersist()
            seen.unpersist()
        return Classifier(words, fitted.coefficients.toArray().tolist(), float(fitted.intercept), model)
    finally:
        sample.unpersist()


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, th (hash of the text), score and predicted of every row of ``docs``; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            scores = [classifier.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "th", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("th"), body().alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, score (0 to 1) and predicted, from the text alone.

    Rows may repeat and get equal scores; other columns are not read; an empty table gives an empty result.
    """
    result = scored(docs, fit(docs, labels))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns (a pipeline stage).

    A null text scores as an empty one, repeated rows score alike, an empty table stays empty.
    """
    classifier = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bad = [classifier.score(t) >= 0.5 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad, pa.bool_()))], names=["node"])

    node, key = fresh(docs, "node"), F.xxhash64(F.col("doc_id").cast("long"), body())
    bad = checkpointed(docs.select(key.alias("node"), body().alias("text")).mapInArrow(run, "node long").select(F.col("node").alias(node)).distinct())
    return docs.join(hinted(bad), key == F.col(node), "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
