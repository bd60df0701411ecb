"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table

#: Each byte of a word, with A-Z lower-cased, or a space: words are what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ finds then.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Phrases that a document is searched for whole, and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices, found where a block of text contains the threshold of their distinct words.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = 0.8
#: A block is BLOCK words and begins every STEP words; whatever stands within BLOCK - STEP words is inside some block.
BLOCK, STEP = 128, 64


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _counted(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("_text"):
                counts.update(filter(vocabulary.__contains__, text_words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _blocked(rare: frozenset[bytes]):
    """Each text's number of words and the blocks that hold a rare word, or one row without a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n_words, block, words = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                own = text_words(text.as_py())
                steps = {p // STEP for p, w in enumerate(own) if w in rare}
                found: list[int | None] = sorted({b for s in steps for b in (s, s - 1) if b >= 0})
                for b in found or [None]:
                    row.append(i)
                    n_words.append(len(own))
                    block.append(b)
                    words.append(None if b is None else [w.decode("utf-8", "replace") for w in own[b * STEP : b * STEP + BLOCK]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").take(pa.array(row, pa.int64())), pa.array(n_words, pa.int64()), pa.array(block, pa.int32()), pa.array(words, pa.list_(pa.string()))],
                ["_doc", "n_words", "block", "words"],
            )

    return run


def template_rows(phrases: dict[str, str], notices: dict[str, str], threshold: float) -> list[tuple[int, str, bool, list[str], int]]:
    """(template, label, phrase, words, needed): needed is the least number of distinct words that a block must hold. A
    phrase needs all of its words."""
    rows = []
    for words, label in [*phrases.items(), *notices.items()]:
        parts = words.split()
        if not parts or len(parts) > BLOCK - STEP:
            raise ValueError(f"a template must have 1 to {BLOCK - STEP} words")
        whole = words in phrases and phrases[words] == label
        distinct = len(set(parts))
        rows.append((len(rows), label, whole, parts, distinct if whole else max(1, math.ceil(threshold * distinct - 1e-9))))
    return rows


def word_order(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The templates' words, rarest in the whole corpus first (ties by the word): the join's global order."""
    texts = docs.select(F.col("text").cast("binary").alias("_text"))
    words = texts.mapInArrow(_counted(frozenset(w.encode() for w in vocabulary)), "word string, n long")
    counts = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def license_matches(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document and matching block and template: _doc, n_words, block, label, phrase, containment, starts.

    `_doc` is a struct of the document's columns but the text, with a number that tells repeated rows apart. The join is
    exact. Words have one global order, rarest first. A block that holds `needed` of a template's n distinct words holds one of its n - needed + 1 rarest,
    so only blocks with such a prefix word are made at all, and they meet the templates on it. Of a pair met at place i
    of the template, at most min(n - i, block words of the vocabulary from there on) can still be shared (positional
    filter), and a block with fewer vocabulary words than `needed` can't match (length filter). What is left is counted.
    A phrase must then stand word by word: `starts` are the places where it does, each taken from the one block whose
    first STEP words hold it. Documents without a match have one row with nulls.
    """
    spark = docs.sparkSession
    templates = template_rows(phrases, notices, threshold)
    order = word_order(docs, sorted({w for t in templates for w in t[3]}))
    prefix: list[tuple[str, int, int]] = []
    sets = []
    for no, label, phrase, parts, needed in templates:
        ranked = sorted(set(parts), key=order.get)
        prefix += [(w, no, i) for i, w in enumerate(ranked[: len(ranked) - needed + 1])]
        sets.append((no, label, phrase, parts, ranked, needed))
    index = spark.createDataFrame(prefix, "_word string, template int, _at int")
    known = spark.createDataFrame(sets, "template int, label string, phrase boolean, parts array<string>, ranked array<string>, needed int")
    rare = sorted({w for w, _, _ in prefix})
    vocabulary = F.array(*[F.lit(w) for w in sorted(order, key=order.get)])
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*kept, F.monotonically_increasing_id().alias("_tie")).alias("_doc"),
        F.col("text").cast("binary").alias("_text"),
    )
    kind = rows.schema["_doc"].dataType.simpleString()
    blocked = rows.mapInArrow(_blocked(frozenset(w.encode() for w in rare)), f"_doc {kind}, n_words long, block int, words array<string>")
    probes = blocked.withColumn("_own", F.array_intersect(vocabulary, F.coalesce("words", F.array().cast("array<string>"))))  # in the global order
    probes = probes.withColumn("_word", F.explode_outer(F.filter("_own", lambda w: w.isin(rare))))
    met = probes.join(F.broadcast(index), "_word", "left").join(F.broadcast(known), "template", "left")  # the templates' words
    # Each pair once: on the first prefix word of the template that the block holds.
    first = F.array_position("_own", F.col("_word"))
    earlier = F.exists(F.slice("ranked", 1, F.col("_at")), lambda w: F.array_contains(F.col("_own"), w))
    reach = F.least(F.size("ranked") - F.col("_at"), F.size("_own") - first + 1)
    candidate = F.col("template").isNotNull() & ~earlier & (F.size("_own") >= F.col("needed")) & (reach >= F.col("needed"))
    shared = F.size(F.array_intersect("ranked", "_own"))
    places = F.filter(
        F.sequence(F.lit(0), F.least(F.lit(STEP), F.size("words")) - 1),
        lambda i: F.slice("words", i + 1, F.size("parts")) == F.col("parts"),
    )
    found = met.withColumn("_shared", F.when(candidate, shared))
    starts = F.when(F.col("phrase") & (F.col("_shared") >= F.col("needed")), F.transform(places, lambda i: (i + F.col("block") * STEP).cast("long")))
    found = found.withColumn("starts", starts)
    matched = (F.col("_shared") >= F.col("needed")) & (~F.col("phrase") | (F.size("starts") > 0))
    none = F.lit(None)
    return found.select(
        "_doc", "n_words", F.when(matched, F.col("block")).alias("block"), F.when(matched, F.col("label")).otherwise(none).alias("label"),
        F.when(matched, F.col("phrase")).alias("phrase"), F.when(matched, F.col("_shared") / F.size("ranked")).alias("containment"),
        F.when(matched, F.col("starts")).alias("starts"),
    )


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest containment of a matched template, 0 without one. A null text has no words; repeated rows
    get a row each; other columns are ignored; an empty table gives no rows.
    """
    found = license_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), phrases, notices, threshold)
    base = F.col("phrase")
    report = found.groupBy("_doc", "n_words").agg(
        F.coalesce(F.sum(F.size("starts")), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"), F.max(F.array_max("starts")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("containment"), F.lit(0.0)).alias("score"),
    )
    return report.select("_doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    """DuckDB SQL of `op1_licenses` by brute force: every phrase at every word, every notice against every block."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    notices = ", ".join(f"('{n}', '{label}')" for n, label in NOTICES.items())
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  p AS (SELECT string_split(col0, ' ') AS ph, col1 AS label, col2 AS n FROM (VALUES {phrases})),
  q AS (SELECT list_distinct(string_split(col0, ' ')) AS nt, col1 AS label FROM (VALUES {notices})),
  places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
  hits AS (SELECT doc_id, i, label FROM places, p WHERE w[i + 1] = ph[1] AND w[i + 1 : i + n] = ph),
  base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY 1),
  blocks AS (SELECT doc_id, list_distinct(w[b * {STEP} + 1 : b * {STEP} + {BLOCK}]) AS s FROM (SELECT doc_id, w, unnest(range((len(w) + {STEP - 1}) // {STEP})) AS b FROM d)),
  shares AS (SELECT doc_id, label, len(list_intersect(s, nt)) / len(nt) AS c FROM blocks, q),
  found AS (SELECT doc_id, label, max(c) AS c FROM shares WHERE c >= {THRESHOLD} - 1e-9 GROUP BY 1, 2 UNION ALL SELECT DISTINCT doc_id, label, 1.0 FROM hits),
  every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM found GROUP BY 1)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)""".replace("\\\\", "\\")


ORACLE = _oracle()


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
