"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import cut, small, table, whole
from wayline.llm.components import spread_join, star_components

#: Words in a shingle, the hash's seed, the most differing bits of a link.
SHINGLE, SEED, BITS = 4, 42, 4
#: (lowest bit, width) of the three segments; each is padded with zeros to the 23 bits of the code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Fingerprints of one key that are compared in one piece; runs up to SMALL are compared all with all.
RUN, SMALL = 8192, 12


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a whole UTF-8 text; 0 if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        octets = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = batch.column("_text")
        values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], [*names, "fp"])


def with_fingerprints(docs: DataFrame, *keep: F.Column) -> DataFrame:
    """The columns `keep` and fp, the fingerprint of the whole text as a signed long."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_text")
    return rows.mapInArrow(_fingerprints, f"{schema}, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; for each syndrome the error patterns of its keys (6 places) and their number.

    The code is perfect: every syndrome has one pattern of at most 3 errors. If that pattern has 3 errors, five more
    codewords lie 4 away; with them, any two words within 2 bits of each other share a codeword: the word midway is
    within 3 of some codeword, which is then within 4 of both, and a codeword 4 away is missing only where another is
    within 2, which the code's distance of 7 rules out.
    """
    upper = np.zeros(4096, np.int64)
    for i in range(4096):
        rest = i << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        upper[i] = rest
    bits = 1 << np.arange(23)
    unit = upper[bits >> 11] ^ (bits & 2047)
    patterns, counts = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    level, syndromes, last = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1)
    counts[0] = 1
    for weight in range(1, 5):
        grown = [(level[last < b] | bits[b], syndromes[last < b] ^ unit[b], np.full((last < b).sum(), b)) for b in range(23)]
        level, syndromes, last = (np.concatenate(x) for x in zip(*grown, strict=True))
        if weight < 4:
            patterns[syndromes, 0], counts[syndromes] = level, 1
            threes = np.zeros(2048, bool)
            threes[syndromes] = weight == 3
        else:
            for pattern, s in zip(level.tolist(), syndromes.tolist(), strict=True):
                if threes[s]:
                    patterns[s, counts[s]] = pattern
                    counts[s] += 1
    return upper, patterns, counts


def segment_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: codeword indices (n, 6) and how many of them count."""
    upper, patterns, counts = golay_tables()
    syndrome = upper[values >> 11] ^ (values & 2047)
    return (values[:, None] ^ patterns[syndrome]) >> 11, counts[syndrome]


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of every fingerprint.

    Four errors leave at least two of the three segments with at most 2 errors each, so two linked fingerprints share a
    pair of codeword indices in at least one of the three pairs of segments.
    """
    words = fps.view(np.uint64)
    parts = [segment_keys(((words >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)) for low, width in SEGMENTS]
    at, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, na), (kb, nb) = parts[a], parts[b]
        for i in range(6):
            for j in range(6):
                rows = np.flatnonzero((na > i) & (nb > j))
                at.append(rows)
                keys.append((pair << 24) | (ka[rows, i] << 12) | kb[rows, j])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 2048):
            at, keys = fingerprint_keys(fps[i : i + 2048])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fps[i : i + 2048][at])], ["key", "fp"])


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among these fingerprints: each one reached is compared with those left."""
    left, found = fps.view(np.uint64), []
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                hits, left = left[near], left[~near]
                found.append((np.full(hits.size, x), hits))
                todo.extend(hits)
    return found


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _linked_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    words, found = fps.view(np.uint64), []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, keys.size])
    short = np.repeat((lengths > 1) & (lengths <= SMALL), lengths)
    k, w = keys[short], words[short]
    for shift in range(1, SMALL):
        near = (k[shift:] == k[:-shift]) & (np.bitwise_count(w[shift:] ^ w[:-shift]) <= BITS)
        if near.any():
            found.append((w[:-shift][near], w[shift:][near]))
    for i, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
        found += forest(fps[i : i + n])
    return _pairs(found)


def _links(run: int):
    """From rows sorted by key: links (key null), and the members of runs above `run` with their block (key not null)."""

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "key", "block"])

    def overflow(fps: np.ndarray, key: int, block: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(fps), pa.array(fps), pa.array(np.full(len(fps), key, np.int32)), pa.array(np.full(len(fps), block, np.int32))],
            ["a", "b", "key", "block"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, block, cut_key = np.empty(0, np.int32), np.empty(0, np.int64), 0, None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not keys.size:
                continue
            if block and int(keys[0]) != cut_key:  # the run that overflowed had ended with a block
                block = 0
            if block:  # the run that overflowed goes on
                n = int(np.searchsorted(keys, keys[0], "right"))
                while n >= run or (n and n < keys.size):
                    yield overflow(fps[: min(n, run)], int(keys[0]), block)
                    keys, fps, n, block = keys[min(n, run) :], fps[min(n, run) :], max(0, n - run), block + 1
                if n == 0 and keys.size:  # with no rows left, the key may go on in the next batch
                    block = 0
                else:
                    continue
            last = int(np.searchsorted(keys, keys[-1], "left")) if keys.size else 0
            a, b = _linked_runs(keys[:last], fps[:last])
            if len(a):
                yield linked(a, b)
            keys, fps = keys[last:], fps[last:]
            while keys.size >= run:
                cut_key = int(keys[0])
                yield overflow(fps[:run], cut_key, block)
                keys, fps, block = keys[run:], fps[run:], block + 1
        if keys.size:
            if block:
                yield overflow(fps, int(keys[0]), block)
            else:
                a, b = _linked_runs(keys, fps)
                yield linked(a, b)

    return read


def _block_links(group: pa.Table) -> pa.Table:
    a, b = _pairs(forest(np.unique(group.column("fp").to_numpy())))
    return pa.table({"a": a, "b": b})


def fingerprint_links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints as all links within BITS bits would.

    Rows are dealt and sorted by key and read as a stream, so memory is bounded by `run` fingerprints of 8 bytes. A key
    with more than `run` of them is cut into blocks, and every two blocks meet in a group of their own.
    """
    keyed = fps.mapInArrow(_keyed, "key int, fp long").repartition("key").sortWithinPartitions("key")
    found = cut(keyed.mapInArrow(_links(run), "a long, b long, key int, block int"))
    members = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    blocks = members.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    met = members.join(blocks, "key").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return found.where("key is null").select("a", "b").unionByName(met.applyInArrow(_block_links, "a long, b long"))


def component_ids(prints: DataFrame, run: int = RUN) -> DataFrame:
    """prints: doc_id, fp. One row per distinct fp: fp, root (one fp of the component), component_id, the smallest doc_id
    reachable from it. Two components may share that where rows repeat a doc_id; no two share a root."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = star_components(fingerprint_links(distinct.select("fp"), run))
    rooted = cut(distinct.join(roots, F.expr("fp = node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    return spread_join(rooted, "root", "fp", ids, "_root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and wordless texts have the fingerprint 0, linked like any other. Copies share a fingerprint and are
    compared once. A null doc_id is never a component's id unless the component has no other. Repeated rows are kept;
    other columns are ignored; an empty table gives no rows.
    """
    prints = cut(with_fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")))
    ids = component_ids(prints, run).withColumnRenamed("fp", "_fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(prints, "fp", "doc_id", ids, "_fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one left of each component: the one of the smallest doc_id, then of the smallest text checksum.

    Columns are those of `docs`. Null, empty and wordless texts are one component. A row without an id stays only where
    its component has none with one. Rows that repeat the one that stays in id and text go too, whatever their order: the
    least by its other columns stays. An empty table gives no rows.
    """
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    prints = cut(with_fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key")))
    ids = component_ids(prints.select("doc_id", "fp")).withColumnRenamed("fp", "_fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("best")
    grouped = spread_join(prints, "fp", "_key", ids, "_fp").groupBy("root").agg(best)
    kept = grouped.select(F.col("best.doc_id").alias("_kept_id"), F.col("best._key").alias("_kept_key"))
    repeats = prints.groupBy(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.join(repeats, F.expr("_kept_id <=> _i and _kept_key = _k")).select("_kept_id", "_kept_key", "_times")
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id"), key.alias("_row_key"))
    found = rows.join(kept, F.expr("_id <=> _kept_id and _row_key = _kept_key"))
    once = found.where("_times = 1").select("_doc.*")
    # The text is the same but for null and empty.
    others = F.to_json(F.struct(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    order = F.struct(F.col("_doc.text").isNull(), others)
    least = found.where("_times > 1").groupBy("_kept_id", "_kept_key").agg(F.min_by("_doc", order).alias("_doc"))
    return once.unionByName(least.select("_doc.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
