"""Toxicity by non-negative positive-unlabelled learning on words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import crc_fold, cut, small, table
from wayline.llm.linear import sigmoid
from wayline.llm.sums import task_sum, total

#: Folds and the one not learned from; most confirmed documents to learn from; words in the model.
FOLDS, HELD_OUT = 5, 0
POSITIVES, WORDS = 8000, 512
#: Steps of descent and the rate of the first, which falls to nothing over them; the shrinkage of the weights.
STEPS, RATE, SHRINK = 60, 0.2, 1e-4
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: A word counts if its document frequencies lie so many standard deviations apart.
APART = 4.5
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def strength(n: int) -> float:
    """What n occurrences of a word count for: 1 for one, growing slowly, at most 3."""
    return min(math.log2(1 + n), 3.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many confirmed and in how many of all documents each word is; the empty word stands for all documents."""
    p: Counter[str] = Counter()
    u: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        words = list(u)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([p[w] for w in words], pa.int64()), pa.array([u[w] for w in words], pa.int64())], ["word", "p", "u"])

    for batch in small(batches):
        for text, positive in zip(batch.column("text"), batch.column("positive").to_pylist(), strict=True):
            words = {"", *_WORD.findall((text.as_py() or "").lower())}
            u.update(words)
            if positive:
                p.update(words)
        if len(u) > COUNTED:
            yield counted()
            p.clear()
            u.clear()
    yield counted()


def _indexed(chosen: list[str]):
    """The model's words of each document that has any."""
    index = {w: i for i, w in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            flags, at, value = [], [], []
            for text, positive in zip(batch.column("text"), batch.column("positive").to_pylist(), strict=True):
                counts = word_counts(text.as_py())
                if found := sorted((index[w], strength(counts[w])) for w in counts.keys() & index.keys()):
                    flags.append(positive)
                    at.append([i for i, _ in found])
                    value.append([v for _, v in found])
            yield pa.RecordBatch.from_arrays([pa.array(flags, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["positive", "at", "value"])

    return run


def _risk_sums(w: np.ndarray):
    """A task's share of the risk's parts at w: see `fit`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(w)
        plain, moved, rest = np.zeros(d), np.zeros((2, d)), np.zeros(4)
        for batch in batches:
            at, value, positive = batch.column("at"), batch.column("value").flatten().to_numpy(), batch.column("positive").to_numpy() == 1
            rows, column = np.repeat(np.arange(batch.num_rows), pc.list_value_length(at).to_numpy()), at.flatten().to_numpy()
            z = np.bincount(rows, value * w[column], batch.num_rows) + w[-1]
            s = sigmoid(z)
            for out, share in ((plain, positive * 1.0), (moved[0], s), (moved[1], s * positive)):
                out[:-1] += np.bincount(column, value * share[rows], d - 1)
                out[-1] += share.sum()
            rest += [np.logaddexp(0, z).sum(), np.logaddexp(0, z[positive]).sum(), len(z), positive.sum()]
        yield task_sum(np.concatenate([plain, *moved, rest]))

    return run


def fit(rows: DataFrame, words: int, n_p: int, n_u: int, prior: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights and, last, the intercept of a linear scorer under the non-negative positive-unlabelled risk.

    With the logistic loss l(z, y) the risk is prior * E_P l(z, 1) + max(0, E_U l(z, 0) - prior * E_P l(z, 0)), over all
    n_u documents and the n_p confirmed ones; `rows` are those with a word of the model, the others only have the
    intercept. Each of Adam's steps is one pass that sums the gradient in the tasks. When the bracket falls below zero,
    the step goes up its gradient instead, so that the model can't drive an estimate of the negatives' loss below what is
    possible.
    """
    d = words + 1
    shrink = np.full(d, SHRINK)
    shrink[-1] = 0
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    w[-1] = math.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sums = total(rows.mapInArrow(_risk_sums(w), "vector binary"))
        sums = sums if sums.size else np.zeros(3 * d + 4)
        plain, all_moved, p_moved = sums[: 3 * d].reshape(3, d).copy()
        loss_u, loss_p, seen, seen_p = sums[3 * d :]
        s, soft = float(sigmoid(w[-1])), float(np.logaddexp(0, w[-1]))  # of documents without a word of the model
        plain[-1] += n_p - seen_p
        all_moved[-1] += s * (n_u - seen)
        p_moved[-1] += s * (n_p - seen_p)
        bracket = (loss_u + soft * (n_u - seen)) / n_u - prior * (loss_p + soft * (n_p - seen_p)) / n_p
        negatives = all_moved / n_u - prior * p_moved / n_p
        gradient = -negatives if bracket < 0 else prior * (p_moved - plain) / n_p + negatives + shrink * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(labels: DataFrame) -> float:
    """The share of toxic rows among the labelled ones outside the held-out fold."""
    known = labels.where("toxic is not null").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    row = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()
    return float(min(max(row[0] or 0.0, 1e-3), 0.9))


class Model:
    """Weights of words; every other word weighs nothing."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def margin(self, text: str | None) -> float:
        counts = word_counts(text)
        return self.intercept + math.fsum(self.weights[w] * strength(counts[w]) for w in counts.keys() & self.weights.keys())


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, words: int = WORDS) -> Model:
    """Learn from at most `positives` documents confirmed toxic (chosen by hash) and, as unlabelled ones, from all
    documents of the learning folds.

    Words are ranked by how far their document frequency among the confirmed lies above (or below) that among all, in
    standard deviations; tasks count their own documents first, and `words` words come to the driver. The risk is summed
    over all documents in Spark.
    """
    known = labels.where("toxic = 1 and doc_id is not null").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    picked = known.select(F.col("doc_id").cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(positives)
    learn = docs.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = learn.join(F.broadcast(cut(picked)), F.expr("doc_id = _id"), "left")  # at most `positives` ids
    marked = marked.select(F.col("_id").isNotNull().cast("int").alias("positive"), "text")
    counts = marked.mapInArrow(_frequencies, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = cut(counts)
    everything = counts.where("word = ''").first()
    n_p, n_u = (everything["p"], everything["u"]) if everything else (0, 0)
    if not n_p:
        return Model({}, -20.0)
    prior = class_prior(labels)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    away = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    ranked = counts.where("word <> '' and p + u >= 3").withColumn("away", away).where(F.abs("away") >= APART).orderBy(F.desc(F.abs("away")), "word").limit(words)
    chosen = [r["word"] for r in ranked.collect()]
    if not chosen:
        return Model({}, math.log(prior / (1 - prior)))
    rows = cut(marked.mapInArrow(_indexed(chosen), "positive int, at array<int>, value array<float>"))
    w = fit(rows, len(chosen), n_p, n_u, prior)
    return Model(dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores = sigmoid(np.array([model.margin(t.as_py()) for t in batch.column("text")], np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score reads the whole text and nothing else; a null or empty text has the intercept's score. Without a confirmed
    toxic document outside the held-out fold everything scores about 0. Null labels and labels of unknown documents are
    ignored; a null doc_id counts as the empty text in the fold. Repeated rows get equal rows; an empty table gives none.
    """
    model = train(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
