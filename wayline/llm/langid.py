"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import crc_fold, cut, small, table, whole

#: N-grams in a profile, longest n-gram, about how many documents of a language train, the fold that isn't learned from.
PROFILE, GRAM, TRAIN_DOCS, FOLDS, HELD_OUT = 400, 3, 1500, 4, 2
UNKNOWN = "und"
#: Up to so many languages are broadcast; beyond that Spark joins them by shuffle.
FEW_LANGUAGES = 10_000
_BITS = 21  # of a code point


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.int64)
    points[0xD800:0xE000] = 0
    return np.where([chr(p).isalpha() for p in points.tolist()], points, 0)


def gram_keys(text: str | None) -> np.ndarray:
    """Every n-gram of the lower-cased text's letter runs, as one number each.

    A run stands between word marks (code point 32); a mark is only ever an n-gram's first or last place, and never alone.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    points = _letters()[points]
    letter = points > 0
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.r_[0, points, 0]
    letter = points > 0
    points = points[letter | np.r_[True, letter[:-1]]]  # of the places between two runs, the first
    points[points == 0] = 32
    mark = points == 32
    grams = [points[~mark]]
    for n in range(2, GRAM + 1):
        last = len(points) - n + 1
        if last < 1:
            break
        key, inner = np.zeros(last, np.int64), np.zeros(last, bool)
        for i in range(n):
            key = (key << _BITS) | points[i : i + last]
            if 0 < i < n - 1:
                inner |= mark[i : i + last]
        grams.append(key[~inner & ~(mark[:last] & mark[n - 1 : n - 1 + last] & (n == 2))])
    return np.concatenate(grams)


def ranked(keys: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys, most frequent first, ties to the smaller key."""
    values, counts = np.unique(keys, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            values, counts = np.unique(gram_keys(text), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])


def train_profiles(docs: DataFrame, train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over about `train_docs` of its documents, chosen by hash (all, if fewer).

    Documents aren't moved to be chosen: a language's share is known from a count. The n-gram counts are summed in Spark;
    what comes to the driver is the model, `profile` numbers for each language.
    """
    sample = (
        docs.where("lang is not null and text is not null")
        .where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    )
    shares = sample.groupBy(F.col("lang").alias("_of")).agg((F.lit(float(train_docs)) / F.count(F.lit(1))).alias("_share"))
    shares = cut(shares)
    if shares.count() <= FEW_LANGUAGES:
        shares = F.broadcast(shares)
    chance = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    picked = sample.join(shares, F.expr("lang = _of")).where(chance < F.col("_share"))
    # Dealt in turn, not by text: copies of one text would land in one task.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = picked.select("lang", "text").repartition(partitions).mapInArrow(_gram_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "rank", "gram").toLocalIterator():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(pairs)], np.int64) for lang, pairs in sorted(found.items())}


class Profiles:
    """All profiles as one sorted table of n-grams with their rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for j, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), j] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least out-of-place distance (ties: the first by name), and 1 - distance over the most
        possible; a missing n-gram is out of place by the profile's size."""
        keys = ranked(gram_keys(text), self.size)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        at[self.grams[at] != keys] = len(self.grams)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(keys)))


def _predict(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("_text") if "_text" in batch.schema.names else batch.column("_doc").field("text")
            found = [profiles.predict(t.as_py()) for t in texts]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*names, "_lang_pred", "_lang_score"],
            )

    return run


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], *keep: F.Column) -> DataFrame:
    """The columns `keep`, and _lang_pred and _lang_score of the whole text; without `keep`, the document as `_doc`."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text")) if keep else docs.select(whole(docs))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_text")
    return rows.mapInArrow(_predict(Profiles(profiles)), f"{kept}, _lang_pred string, _lang_score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Profiles come from documents outside the held-out fold with a language. Null texts and texts without a letter are
    `und` with score 0, as is everything if there is nothing to learn from. A null doc_id counts as the empty text in the
    fold. Repeated rows get equal rows; an empty table gives none.
    """
    keep = F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    found = with_language(docs, train_profiles(docs), *keep)
    return found.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def keep_known_languages(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The documents, without those of no language and those that are near no profile (score under `least`).

    Null texts, empty texts and texts without a letter have no language and go, as does everything where no document
    outside the held-out fold has a language. Whole texts of any length are read. Columns are those of `docs`; the
    document's own `lang` isn't looked at or changed; repeated rows stay or go alike; an empty table gives no rows.
    """
    found = with_language(docs, train_profiles(docs))
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select("_doc.*")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
