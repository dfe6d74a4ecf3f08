"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

Grades are 0 for rows labelled clean; toxic ones get 1 to GRADES by the summed log(1 + count) of their words that the
labels associate with toxicity, cut at equal counts of rows that have such words; rows without any get 1. ``P(grade <= k) = sigmoid(threshold_k - w.x)``: the
weights w are shared by all thresholds, which are kept in order. Features are log(1 + count) of the words
(runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z) that tell the classes apart best.
The fit sees at most about TRAIN_ROWS labelled rows, chosen by a hash of the id, and one of equal texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdlens.llm.words import ALNUM, steps, words

#: Bound on the rows that the fit sees, on the words that are features, and least rows with a word.
TRAIN_ROWS, FEATURES, LEAST_ROWS = 8000, 1024, 10
#: Least chi-square of a word and toxicity, so that few words are features by chance.
LEAST_CHI = 15.0
GRADES = 3
#: Penalty on the weights, steps of the fit.
RIDGE, ITERATIONS = 0.00003, 400


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grade_probabilities(model: Model, score: np.ndarray) -> np.ndarray:
    """Probability of each grade for each ``w.x``."""
    below = np.concatenate((np.zeros((len(score), 1)), _sigmoid(model.thresholds[None] - score[:, None]), np.ones((len(score), 1))), 1)
    return np.diff(below, axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood; the matrix has ``values`` at (rows, columns)."""
    n, k = len(grade), int(grade.max(initial=0))
    k = max(k, 1)
    share = np.clip([(grade <= j).mean() if n else 0.5 for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # thresholds: the first, then positive gaps as logarithms
    free = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-2)), np.zeros(n_columns)))
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, ITERATIONS + 1):
        gaps = np.exp(free[1:k])
        theta = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        w = free[k:]
        score = np.bincount(rows, values * w[columns], minlength=n)
        up = _sigmoid(np.append(theta, np.inf)[np.minimum(grade, k)] - score)
        up[grade >= k] = 1
        low = np.where(grade > 0, _sigmoid(theta[np.maximum(grade - 1, 0)] - score), 0)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = np.where(grade < k, up * (1 - up), 0) / p, low * (1 - low) / p
        d_theta = np.bincount(np.minimum(grade, k - 1), d_up * (grade < k), minlength=k) - np.bincount(np.maximum(grade - 1, 0), d_low * (grade > 0), minlength=k)
        d_score = -(d_up - d_low)
        d_w = np.bincount(columns, values * d_score[rows], minlength=n_columns) / max(n, 1) - RIDGE * w
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate(([tail[0]], tail[1:] * gaps)) / max(n, 1)
        grad = np.concatenate((grad, d_w))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        free = free + 0.05 * (1 - (t - 1) / ITERATIONS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(free[1:k])
    return free[k:], free[0] + np.concatenate(([0.0], np.cumsum(gaps)))


def severity_grades(toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """0 where not ``toxic``, else 1 to GRADES by ``weight``, cut at equal counts of those that have any; without any 1."""
    grade = (toxic == 1).astype(np.int64)
    told = (toxic == 1) & (weight > 0)
    if told.any():
        some = np.round(weight[told], 9)  # sums in another order tie alike
        grade[told] += np.searchsorted(np.round(np.quantile(some, np.arange(1, GRADES) / GRADES), 9), some, side="right")
    return grade


def _counts(docs: DataFrame) -> DataFrame:
    """``(hash, toxic, n_words, words, counts)``: the distinct words' hashes of each row."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, data, offsets in steps(batch.column("text")):
                w = words(data, offsets, ALNUM)
                for i in range(b - a):
                    h, c = np.unique(w.hash[w.rows[i] : w.rows[i + 1]], return_counts=True)
                    out.append((int(c.sum()), h.view(np.int64), c))
            if out:
                yield pa.record_batch([batch.column("hash"), batch.column("toxic"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["hash", "toxic", "n_words", "words", "counts"])

    return docs.select("hash", F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(run, "hash long, toxic int, n_words long, words array<long>, counts array<long>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; null labels and ids are left out.

    An id with several labels is toxic if one says so, and so is a text that several rows have; labels above 0 mean toxic. Without labels or documents nothing is a
    feature and the thresholds say that grade 0 is likely.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    part = min(1.0, TRAIN_ROWS / max(1, known.count()))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53) < part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS bounds it
    # copies aren't further evidence; toxic if one of them is
    rows = rows.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    counts = _counts(rows).persist()
    classes = {r.toxic: r["n"] for r in counts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_toxic = sum(classes.values()), classes.get(1, 0)
    spread = counts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("hits")).where(F.col("df") >= LEAST_ROWS)
    best: list = []
    if 0 < n_toxic < n:
        odds = F.log((F.col("hits") + 0.5) / (n_toxic - F.col("hits") + 0.5)) - F.log((F.col("df") - F.col("hits") + 0.5) / (n - n_toxic - F.col("df") + F.col("hits") + 0.5))
        expected = F.col("df") * n_toxic / n
        chi = (F.col("hits") - expected) ** 2 / (expected * (1 - n_toxic / n))
        best = spread.withColumn("odds", odds).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.col("chi").desc(), "word").limit(FEATURES).collect()
    vocabulary = np.sort(np.array([r.word for r in best], np.int64).view(np.uint64))
    odds_of = {r.word: r.odds for r in best}
    lexicon = np.array([odds_of[int(x)] >= 2 for x in vocabulary.view(np.int64)], bool)
    known_words = F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in vocabulary.view(np.int64)], "word long")) if len(vocabulary) else None
    data = []
    if known_words is not None:
        each = counts.select("hash", "toxic", "n_words", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("hash", "toxic", "n_words", F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
        data = each.join(known_words, "word").groupBy("hash").agg(F.first("toxic").alias("toxic"), F.first("n_words").alias("n_words"), F.collect_list(F.struct("word", "count")).alias("x")).collect()
    counts.unpersist()
    toxic = np.array([r.toxic for r in data] + [1] * max(0, n_toxic - sum(r.toxic for r in data)) , np.int64)
    toxic = np.append(toxic, np.zeros(max(0, n - len(toxic)), np.int64))  # rows without any feature
    index = np.array([i for i, r in enumerate(data) for _ in r.x], np.int64)
    word = np.array([x["word"] for r in data for x in r.x], np.int64).view(np.uint64)
    count = np.array([x["count"] for r in data for x in r.x], np.float64)
    column = np.searchsorted(vocabulary, word)
    weight = np.zeros(len(toxic))
    if len(index):
        weight[: len(data)] = np.bincount(index, np.log1p(count) * lexicon[column], minlength=len(data))
    grade = severity_grades(toxic, weight)
    weights, thresholds = fit_ordinal(index, column, np.log1p(count), grade, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def grade_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, expected_severity, grade, p_toxic, toxic)`` of each row; a null or empty text has no features.

    expected_severity: the mean of the predicted grades; grade: the likeliest; toxic: grade 0 is less likely
    than the others together.
    """
    present = np.zeros(1 << 16, bool)
    present[model.vocabulary & np.uint64(0xFFFF)] = True

    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, data, offsets in steps(batch.column("text")):
                w = words(data, offsets, ALNUM)
                hit = np.flatnonzero(present[w.hash & np.uint64(0xFFFF)])
                if not len(hit):
                    continue
                column = np.minimum(np.searchsorted(model.vocabulary, w.hash[hit]), len(model.vocabulary) - 1)
                same = model.vocabulary[column] == w.hash[hit]
                row = np.searchsorted(w.rows, hit[same], side="right") - 1
                pair, count = np.unique(row * len(model.vocabulary) + column[same], return_counts=True)
                score[a:b] += np.bincount(pair // len(model.vocabulary), np.log1p(count) * model.weights[pair % len(model.vocabulary)], minlength=b - a)
            p = grade_probabilities(model, score)
            severity = np.round(p @ np.arange(p.shape[1]), 6)
            rest = np.round(1 - p[:, 0], 6)
            yield pa.record_batch([batch.column("doc_id"), pa.array(severity), pa.array(p.argmax(1).astype(np.int32)), pa.array(rest), pa.array(rest > 0.5)], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
