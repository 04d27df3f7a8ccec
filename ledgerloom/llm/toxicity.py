"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words and the character 5- and 6-grams inside them (with word ends), so
inflected forms share weight; a feature counts ln(1 + occurrences). Those that go with
a label are picked by their chi-squared statistic on a bounded labelled sample. The
table marks documents only as toxic or not, so toxic ones of the sample are graded 1 to
3 by thirds of the number of their words that hold a feature seen in toxic documents
only or nearly so. One weight vector and ordered thresholds give P(grade >= k) =
sigmoid(w x - t_k); the expected severity is their sum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save, scratch

#: Labelled documents of each label that a model is fitted on, at most.
SAMPLE = 3000
#: Features, at most, and documents of the sample that one must be in.
FEATURES, LEAST_DOCS = 2048, 4
#: The chi-squared statistic that a feature must pass: one chance in ten thousand, as many are tried.
LEAST_CHI = 15.1
#: Grades above none.
GRADES = 3
#: Words whose features a task keeps, at most.
MOST_WORDS = 400_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> set[str]:
    ends = f"^{word}$"
    return {ends} | {ends[i : i + n] for n in (5, 6) for i in range(len(ends) - n + 1)}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to GRADES, one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


@dataclass
class Sparse:
    """Rows of few values: ``rows``, ``columns`` and ``values`` of each that isn't 0."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.shape[1])


def loss_and_gradient(x: Sparse, y: np.ndarray, weight: np.ndarray, at: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """The negative cumulative-link log likelihood with a ridge on the weights, and its gradient.

    ``at`` holds a weight for each feature, the first threshold, and the logarithms of the
    gaps to the next ones, so thresholds stay in order.
    """
    w, free = at[: x.shape[1]], at[x.shape[1] :]
    gaps = np.exp(free[1:])
    t = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
    s = 1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - t, -30, 30)))  # P(grade >= k)
    upper = np.where(y > 0, np.take_along_axis(s, np.maximum(y - 1, 0)[:, None], 1)[:, 0], 1.0)
    lower = np.where(y < grades, np.take_along_axis(s, np.minimum(y, grades - 1)[:, None], 1)[:, 0], 0.0)
    p = np.maximum(upper - lower, 1e-12)
    up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
    k = np.arange(grades)
    by_t = weight @ (down[:, None] * (k == y[:, None]) - up[:, None] * (k == (y - 1)[:, None]))
    tail = np.cumsum(by_t[::-1])[::-1]
    gradient = np.concatenate([x.transposed_times(weight * (up - down)) - ridge * w, [tail[0]], tail[1:] * gaps])
    return float(ridge / 2 * w @ w - weight @ np.log(p)), -gradient


def fit_ordinal(x: Sparse, y: np.ndarray, weight: np.ndarray, grades: int = GRADES, ridge: float = 1e-4, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that minimise loss_and_gradient(), by L-BFGS until the gradient is all but 0."""
    weight = weight / weight.sum()
    at = np.concatenate([np.zeros(x.shape[1]), [0.5], np.full(grades - 1, -0.5)])
    value, slope = loss_and_gradient(x, y, weight, at, grades, ridge)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-6:
            break
        way, shares = slope.copy(), []
        for move, turn, inverse in reversed(past):
            shares.append(inverse * (move @ way))
            way -= shares[-1] * turn
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (move, turn, inverse), share in zip(past, reversed(shares), strict=True):
            way += (share - inverse * (turn @ way)) * move
        length, fall = 1.0 if past else 1.0 / max(1.0, np.abs(way).sum()), way @ slope
        while True:  # halved until the loss falls enough
            new, (lower, after) = at - length * way, loss_and_gradient(x, y, weight, at - length * way, grades, ridge)
            if lower <= value - 1e-4 * length * fall or length < 1e-12:
                break
            length /= 2
        move, turn = new - at, after - slope
        if move @ turn > 1e-12:
            past = [*past[-19:], (move, turn, 1 / (move @ turn))]
        elif length < 1e-12:
            break
        at, value, slope = new, lower, after
    free = at[x.shape[1] :]
    return at[: x.shape[1]], free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each label, chosen by a hash of doc_id.

    Without documents of both labels there are no features and every severity is 0.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, sample)


def _fit(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    by_hash = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    picked = save(by_hash(0).union(by_hash(1)), "toxic_sample")
    spread = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    texts = save(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("toxic").cast("int"), F.col("text").cast("string")), "toxic_texts")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    none = Model({}, np.zeros(0), np.full(GRADES, 40.0))
    if len(n) < 2:
        return none

    def bags() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [list(set().union(*map(word_features, set(words(t))))) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])

        return step

    # How many documents of the sample hold each feature: counted by Spark, so only the chosen ones reach the driver.
    held = map_rows(texts, bags, "toxic int, features array<string>", rows=16).select("toxic", F.explode("features").alias("feature"))
    a, b, total = F.col("a").cast("double"), F.col("b").cast("double"), n[0] + n[1]
    chi = total * (b * (n[0] - a) - a * (n[1] - b)) ** 2 / ((a + b) * F.greatest(total - a - b, F.lit(1.0)) * n[0] * n[1])
    counted = held.groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    chosen = counted.withColumn("chi", chi).where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    if not chosen:
        return none
    features = {r["feature"]: i for i, r in enumerate(chosen)}
    marks = {r["feature"] for r in chosen if r["b"] / n[1] > 5 * (r["a"] + 0.5) / n[0] and r["a"] <= r["b"] / 20}

    def sparse() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, counts, marked = [], [], []
            for text in batch.column(1).to_pylist():
                own: Counter = Counter()
                hits = 0
                for w, c in Counter(words(text)).items():
                    hit = word_features(w) & features.keys()
                    own.update(dict.fromkeys((features[f] for f in hit), c))
                    hits += c * bool(hit & marks)
                at.append(sorted(own)), counts.append([own[f] for f in sorted(own)]), marked.append(hits)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(marked, pa.int64())], ["toxic", "at", "counts", "marked"])

        return step

    rows = map_rows(texts, sparse, "toxic int, at array<int>, counts array<int>, marked long", rows=64).collect()  # 2 * sample short rows at most
    rows.sort(key=lambda r: (r["toxic"], r["marked"], r["at"], r["counts"]))  # sums don't depend on the order of rows
    x = Sparse(np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows]), np.array([i for r in rows for i in r["at"]], np.int64), np.log1p(np.array([c for r in rows for c in r["counts"]], np.float64)), (len(rows), len(features)))
    toxic, marked = np.array([r["toxic"] == 1 for r in rows]), np.array([r["marked"] for r in rows])
    cuts = np.quantile(marked[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, marked, "left"), 0)
    weights, thresholds = fit_ordinal(x, grade, np.where(toxic, spread[1] / n[1], spread[0] / n[0]))
    return Model(features, weights, thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES), grade (the likeliest), toxic, of each whole text.

    Null and empty texts have no features, so all get the same low severity; repeated rows
    get equal results; other columns are ignored.
    """

    def make():
        features, weights = model.features, model.weights
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            if len(known) >= MOST_WORDS:
                known.clear()
            out = known[word] = tuple(features[f] for f in word_features(word) if f in features)
            return out

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = []
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                for w, c in Counter(words(text)).items():
                    hit = known.get(w)
                    for f in of(w) if hit is None else hit:
                        counts[f] += c
                raw.append(sum(weights[f] * np.log1p(c) for f, c in counts.items()))
            p = model.expected(np.array(raw, np.float64))
            exact = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(exact.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)], ["doc_id", "severity", "grade", "toxic"])

        return step

    return map_rows(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), make, "doc_id long, severity double, grade int, toxic boolean")
