"""Document quality by co-training a text-content and a page-metadata classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import crc_fold, cut, small, stored, table, whole
from wayline.llm.linear import fit_logistic, predict, sigmoid
from wayline.llm.sums import few_tasks, symmetric, task_sum, total, upper

#: Folds and the one not learned from; most labelled documents to learn from; one in CALIBRATION of them calibrates.
FOLDS, HELD_OUT, LABELLED, CALIBRATION = 5, 0, 6000, 4
#: Rounds, Newton steps from nothing in each, how sure a view must be of a pseudo-label, and what all of a class weigh at
#: most together, as a share of the class's labelled documents.
ROUNDS, NEWTON, SURE, WEIGHT = 3, 6, 0.95, 0.5
#: Shrinkage of the views' weights, the longest step.
L2, LONGEST = 2.0, 4.0
#: Hash buckets of the content view, of a page's language and of its source.
BUCKETS, LANGS, SOURCES = 256, 8, 16
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+")
_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128), (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, [9, 10, 11, 12, 13, 32]), np.isin(_BYTES, list(b".,")), np.isin(_BYTES, list(b"!?;:'\"()-")),
    np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
]).astype(np.float64)
#: Features of each view: words and the shape of the wording; layout, language and source.
CONTENT, LAYOUT = BUCKETS + 14, 6
META = LAYOUT + LANGS + SOURCES
#: Numbers in what a task hands on in a round.
NOTHING = sum(2 * (1 + d + d * (d + 1) // 2) for d in (CONTENT + 1, META + 1))


def content_view(text: str | None) -> np.ndarray:
    """What the whole text says: hashed words, symbol runs and numbers, as logarithms of their rate in 1000 tokens; shares of
    kinds of letters; how far words and lines repeat."""
    text = text or ""
    counts = Counter(_TOKEN.findall(text.lower()))
    out = np.zeros(CONTENT)
    for token, n in counts.items():
        out[zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS] += n
    out[:BUCKETS] = np.log1p(out[:BUCKETS] * (1000 / max(1, out[:BUCKETS].sum())))
    data = text.encode("utf-8", "replace")
    shares = _CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    lines, words = [line for line in text.split("\n") if line.strip()], text.split()
    top = Counter(lines).most_common(1)
    n_lines, n_words, kinds = max(1, len(lines)), max(1, len(words)), len(set(words))
    out[BUCKETS : BUCKETS + 7] = shares
    out[BUCKETS + 7 :] = (
        len(set(lines)) / n_lines, (top[0][1] - 1) / n_lines if top else 0, kinds / n_words, kinds / np.sqrt(n_words) / 10, np.log1p(len(data) / n_words),
        shares[0] / max(1e-9, shares[0] + shares[1]), np.log1p(n_words) / 10,
    )
    return out


def metadata_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of a page without reading its words: language, source, and its layout: bytes, lines, their lengths
    and how much of it is blank."""
    lines = (text or "").split("\n")
    sizes = np.array([len(line) for line in lines if line.strip()] or [0], float)
    out = np.zeros(META)
    out[:LAYOUT] = (
        np.log1p(len((text or "").encode("utf-8", "replace"))), np.log1p(len(sizes)), np.log1p(sizes.mean()), np.log1p(sizes.max()),
        sizes.std() / max(1.0, sizes.mean()), 1 - len(sizes) / len(lines),
    )
    if lang is not None:
        out[LAYOUT + zlib.crc32(lang.encode("utf-8", "replace")) % LANGS] = 1
    if source is not None:
        out[LAYOUT + LANGS + zlib.crc32(source.encode("utf-8", "replace")) % SOURCES] = 1
    return out


class Views:
    """One model for each view, on standardised features; the calibration of each; their combination."""

    def __init__(self, scale: list[tuple[np.ndarray, np.ndarray]]):
        self.scale, self.models = scale, [np.zeros(0), np.zeros(0)]
        self.calibration, self.combined, self.constant = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0]), None

    def margins(self, view: int, x: np.ndarray) -> np.ndarray:
        mean, spread = self.scale[view]
        return predict((x - mean) / spread, self.models[view])

    def fit(self, view: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        mean, spread = self.scale[view]
        self.models[view] = fit_logistic((x - mean) / spread, y, weight, l2=L2)

    def sureness(self, view: int, x: np.ndarray) -> np.ndarray:
        """A view's own calibrated probability of good quality."""
        return sigmoid(predict(self.margins(view, x)[:, None], self.calibration[view]))

    def calibrated(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.stack([predict(self.margins(v, xs[v])[:, None], self.calibration[v]) for v in (0, 1)], 1)

    def calibrate(self, xs: list[np.ndarray], y: np.ndarray) -> None:
        self.calibration = [fit_logistic(self.margins(v, xs[v])[:, None], y, l2=0.01) for v in (0, 1)]
        self.combined = fit_logistic(self.calibrated(xs), y, l2=0.1)

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        """The probability of good quality."""
        if self.constant is not None:
            return np.full(len(xs[0]), self.constant)
        return sigmoid(predict(self.calibrated(xs), self.combined))


def _unpacked(content: pa.Array, meta: pa.Array) -> list[np.ndarray]:
    found = []
    for column, kind, width in ((content, np.float16, CONTENT), (meta, np.float32, META)):
        data = b"".join(column.to_pylist()) if isinstance(column, (pa.Array, pa.ChunkedArray)) else b"".join(column)
        found.append(np.frombuffer(data, kind).reshape(-1, width).astype(np.float64))
    return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        kept = [n for n in batch.schema.names if n not in ("_text", "_lang", "_source")]
        texts = batch.column("_text") if "_text" in batch.schema.names else batch.column("_doc").field("text")
        rows = list(zip(texts.to_pylist(), batch.column("_lang").to_pylist(), batch.column("_source").to_pylist(), strict=True))
        content = [content_view(t).astype(np.float16).tobytes() for t, _, _ in rows]
        meta = [metadata_view(*r).astype(np.float32).tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(content, pa.binary()), pa.array(meta, pa.binary())], [*kept, "content", "meta"])


def features(docs: DataFrame, *keep: F.Column) -> DataFrame:
    """The columns `keep`, doc_id, held_out and the two views of every whole document, about 700 bytes each. With `keep`
    the text is taken from the document in `_doc`, so that it goes to Python once."""
    known = F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    read = [F.col(c).cast("string").alias(f"_{c}") for c in (("lang", "source") if keep else ("text", "lang", "source"))]
    rows = docs.select(*keep, *known, *read)
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in ("_text", "_lang", "_source"))
    return rows.mapInArrow(_features, f"{kept}, content binary, meta binary")


def _told(teachers: Views, students: Views, labelled: np.ndarray):
    """A task's sums for a Newton step of both views on the pseudo-labels that the other view gives: for each view and
    class their number, the gradient and the upper half of the curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(1 + d), np.zeros((d, d))) for d in (CONTENT + 1, META + 1) for _ in (0, 1)]
        for batch in small(batches, 2000):
            ids = np.array([-1 if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            fresh = ~np.isin(ids, labelled)
            xs = _unpacked(batch.column("content"), batch.column("meta"))
            for v in (0, 1):
                good = teachers.sureness(1 - v, xs[1 - v])
                mean, spread = students.scale[v]
                for y in (0, 1):
                    a = xs[v][fresh & ((good if y else 1 - good) >= SURE)]
                    a = np.c_[(a - mean) / spread, np.ones(len(a))]
                    p = sigmoid(a @ students.models[v])
                    first, curve = sums[2 * v + y]
                    first[0] += len(a)
                    first[1:] += a.T @ (p - y)
                    curve += (a * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ a
        yield task_sum(np.concatenate([part for first, curve in sums for part in (first, upper(curve))]))

    return run


def _stepped(views: Views, told: np.ndarray, xs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Both models after a Newton step on the labelled documents and the pseudo-labels."""
    models, at = [], 0
    for v in (0, 1):
        mean, spread = views.scale[v]
        a, w = np.c_[(xs[v] - mean) / spread, np.ones(len(y))], views.models[v]
        p, d = sigmoid(a @ w), len(w)
        shrink = np.full(d, L2)
        shrink[-1] = 1e-6
        gradient = a.T @ (p - y) + shrink * w
        curve = (a * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ a + np.diag(shrink)
        size = 1 + d + d * (d + 1) // 2
        given = told[at : at + 2 * size].reshape(2, size)
        at += 2 * size
        have = np.array([(y == label).sum() for label in (0, 1)])
        share = min(WEIGHT, *(given[:, 0] / have))
        for own, n in zip(given, have, strict=True):
            weight = share * n / max(own[0], 1)
            gradient += weight * own[1 : 1 + d]
            curve += weight * symmetric(own[1 + d :], d)
        models.append(w - np.clip(np.linalg.solve(curve, gradient), -LONGEST, LONGEST))
    return models


def co_train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Views:
    """Learn both views from at most `labelled` labelled documents and the pseudo-labels that they give one another.

    In each round each view is calibrated on labelled documents kept back from fitting and scores every document outside
    the held-out fold, and all that it is at least SURE of join the other view's examples; a class's pseudo-labels share a weight of at most WEIGHT of its labelled documents', so neither
    their number nor the larger class takes over. A round is NEWTON passes over all documents, whose gradients and
    curvatures are summed in Spark. In the end a logistic model of the two calibrated margins combines them.

    Labelled documents are chosen by hash; of rows that repeat a doc_id the one with the least views counts.
    """
    known = labels.where("quality is not null and doc_id is not null").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_quality"))
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    sample = rows.select("doc_id", "content", "meta").join(F.broadcast(known), F.expr("doc_id = _id"))  # at most `labelled` ids
    sample = sample.groupBy("doc_id", "_quality").agg(F.min(F.struct("content", "meta")).alias("_views"))
    found = sorted(sample.select("doc_id", "_quality", "_views.*").collect(), key=lambda r: r["doc_id"])
    y = np.array([float(r["_quality"] == 1) for r in found])
    if len(set(y.tolist())) < 2:
        views = Views([])
        views.constant = float(y[0]) if len(y) else 1.0
        return views
    xs = _unpacked([r["content"] for r in found], [r["meta"] for r in found])
    views = Views([(x.mean(0), np.maximum(x.std(0), 1e-3 if x.shape[1] == META else np.r_[np.full(BUCKETS, 0.25), np.full(CONTENT - BUCKETS, 1e-3)])) for x in xs])
    kept_back = np.array([zlib.crc32(f"calibrate {r['doc_id']}".encode()) % CALIBRATION == 0 for r in found])
    if len(set(y[kept_back].tolist())) < 2 or len(set(y[~kept_back].tolist())) < 2:
        kept_back[:] = False
    own, back = [x[~kept_back] for x in xs], kept_back if kept_back.any() else ~kept_back
    for v in (0, 1):
        views.fit(v, own[v], y[~kept_back], np.ones((~kept_back).sum()))
    ids = np.array(sorted(r["doc_id"] for r in found), np.int64)
    others, tasks = few_tasks(rows.where("not held_out").select("doc_id", "content", "meta"))
    for _ in range(rounds):
        views.calibrate([x[back] for x in xs], y[back])
        teachers = Views(views.scale)
        teachers.models, teachers.calibration = views.models, views.calibration
        views.models = [np.zeros_like(w) for w in views.models]
        for _ in range(NEWTON):
            told = total(others.mapInArrow(_told(teachers, views, ids), "vector binary"), tasks)
            views.models = _stepped(views, told if told.size else np.zeros(NOTHING), own, y[~kept_back])
    views.calibrate([x[back] for x in xs], y[back])
    return views


def _score_features(views: Views):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = views.score(_unpacked(batch.column("content"), batch.column("meta")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of good quality), predicted.

    Null and empty texts are scored as such; nulls in lang and source are no feature. Without labels of both classes
    outside the held-out fold, all documents score as the one class there is (good, if none). Repeated rows get equal
    rows; an empty table gives none.
    """
    rows = cut(features(docs))
    scored = rows.mapInArrow(_score_features(co_train(rows, labels)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score_documents(views: Views):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores = views.score(_unpacked(batch.column("content"), batch.column("meta")))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(scores, pa.float64())], ["_doc", "_quality_score"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with the columns of `docs`.

    Both views are made once and stored beside the documents as Parquet, where training reads the views alone. Null and
    empty texts are scored as such, texts of any length whole; nulls in lang and source are no feature; repeated rows stay
    or go alike; without labels of both classes everything is of the one class there is (good, if none); an empty table
    gives no rows.
    """
    rows = stored(features(docs, whole(docs)))
    kind = rows.schema["_doc"].dataType.simpleString()
    scored = rows.select("_doc", "content", "meta").mapInArrow(_score_documents(co_train(rows, labels)), f"_doc {kind}, _quality_score double")
    return scored.where(F.col("_quality_score") >= least).select("_doc.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
