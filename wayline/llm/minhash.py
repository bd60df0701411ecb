"""MinHash near-duplicates by min-max hashing: both ends of each permutation, banded, links confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import LOWER, SPACE_WORD, UPPER, cut, small, stored, table
from wayline.llm.components import spread_join, star_components

#: Percent of the union that a link's intersection has at least.
PERCENT = 80
#: Permutations, each giving two values; values in a band. Half of the bands are of minima, half of maxima, so all values
#: of a band are of different permutations. At a similarity of 0.8 all 36 bands miss a pair once in 1.6 million.
PERMUTATIONS, BAND = 90, 5
BANDS = 2 * PERMUTATIONS // BAND
SEED = 20240301
#: Buckets up to SMALL members have their pairs listed, each pair once over all bands. Larger ones are compared in tasks
#: that hold up to TARGETS shingles of sets and PIVOTS of those that are still apart.
SMALL, TARGETS, PIVOTS = 8, 1 << 20, 1 << 18
#: Members that a set is compared with in one piece; rows below which what is looked for is broadcast (under 20 MB).
PIECE, FEW = 256, 200_000
#: Words that a task remembers the hash of, shingles hashed at once.
KNOWN, AT_ONCE = 500_000, 1 << 15

_MIX, _LONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD, _XOR = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, PERMUTATIONS), dtype=np.uint64) | np.array([[1], [0]], np.uint64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes: of two words in a row, of the one word if there is no other."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if h.size < 2:
        return h ^ _LONE
    two = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * _MIX + h[1:]
    return np.unique((two ^ (two >> np.uint64(29))) * _LONE)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys: each permutation is (x ^ b) * a with odd a, and keeps its least and greatest value."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    low, high = np.empty((PERMUTATIONS, len(sets)), np.uint64), np.empty((PERMUTATIONS, len(sets)), np.uint64)
    x = np.empty_like(flat)
    for i in range(PERMUTATIONS):
        np.bitwise_xor(flat, _XOR[i], out=x)
        np.multiply(x, _ODD[i], out=x)
        low[i], high[i] = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    values = np.concatenate([low, high]).reshape(BANDS, BAND, len(sets))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * _LONE + np.zeros(len(sets), np.uint64)
    for j in range(BAND):
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX + values[:, j]
    return (keys ^ (keys >> np.uint64(29))).T.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()
    for batch in small(batches, 500):
        if not batch.num_rows:
            continue
        sets = [shingles(t.as_py(), known) for t in batch.column("_text")]
        keys, held, size = np.zeros((len(sets), BANDS), np.int64), [], 0
        for i, s in enumerate(sets):
            if s.size:
                held.append(i)
                size += s.size
            if held and (size >= AT_ONCE or i == len(sets) - 1):
                keys[held] = band_keys([sets[j] for j in held])
                held, size = [], 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("at"), pa.array([s.size for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), lists],
            ["doc_id", "at", "n", "set_key", "bands"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("at"), F.col("text").cast("binary").alias("_text"))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share PERCENT of their union."""
    a, b = (a, b) if a.size >= b.size else (b, a)
    if 100 * b.size < PERCENT * a.size:
        return False
    at = np.minimum(np.searchsorted(a, b), a.size - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (a.size + b.size - both)


def set_grams(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: id, at, set_key. One row per id: id, grams, the set's hashes as bytes, read from a document that has it."""
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    met = _texts(docs).join(wanted.withColumnRenamed("at", "_at"), F.expr("at = _at")).select("id", "set_key", "_text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in small(batches, 500):
            sets = [shingles(t.as_py(), known).tobytes() for t in batch.column("_text")]
            same = [xxhash.xxh3_128_digest(s) == k.as_py() for s, k in zip(sets, batch.column("set_key"), strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "grams"])
            yield rows.filter(pa.array(same, pa.bool_()))

    return stored(met.mapInArrow(read, "id long, grams binary").dropDuplicates(["id"]))


def pair_links(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """pairs: a, b, each once. Those that are links. A set with many partners meets them in pieces, in several tasks."""
    sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.expr(f"cast((count(*) - 1) div {PIECE} as int)").alias("_last"))
    dealt = spread_join(pairs, "a", "b", sizes, "_a").select("a", F.expr("cast(pmod(xxhash64(b), _last + 1) as int)").alias("piece"), F.col("b").alias("other"))
    firsts = sizes.select(F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0), "_last")).alias("piece"), F.col("_a").alias("other"))
    rows = dealt.withColumn("turn", F.lit(1)).unionByName(firsts.withColumn("turn", F.lit(0))).join(grams, F.expr("other = id")).drop("id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, other, turn, g in zip(*(batch.column(c) for c in ("a", "other", "turn", "grams")), strict=True):
                one = np.frombuffer(g.as_buffer(), np.uint64)
                if turn.as_py() == 0:
                    own = one.copy()
                elif linked(own, one):
                    found.append((a.as_py(), other.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return rows.repartition("a", "piece").sortWithinPartitions("a", "piece", "turn").select("a", "other", "turn", "grams").mapInArrow(verify, "a long, b long")


def _joined(group: pa.Table) -> pa.Table:
    """Links that join the groups (`comp`) of a bucket's sets: each pivot is compared with all that are apart from it."""
    ids, comp, pivot = (group.column(c).to_numpy() for c in ("id", "comp", "pivot"))
    sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in group.column("grams")]
    sizes = np.array([s.size for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts, mark, comp = ends - sizes, np.zeros(flat.max() + 1, np.int64), comp.copy()
    found = []
    for p in np.flatnonzero(pivot):
        fits = (comp != comp[p]) & (100 * np.minimum(sizes, sizes[p]) >= PERCENT * np.maximum(sizes, sizes[p]))
        if not fits.any():
            continue
        own = flat[starts[p] : ends[p]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        hits = np.flatnonzero(fits & (100 * both >= PERCENT * (sizes + sizes[p] - both)))
        for other in np.unique(comp[hits]).tolist():
            found.append((ids[p], ids[hits[comp[hits] == other][0]]))
        comp[np.isin(comp, comp[hits])] = comp[p]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def set_links(docs: DataFrame, sets: DataFrame, small_bucket: int = SMALL, targets: int = TARGETS, pivots: int = PIVOTS) -> DataFrame:
    """sets: id, at, set_key, n, bands. Links (a, b) that connect the sets as all links among band partners would.

    First each set meets the smallest id of each of its buckets, each such pair once; what links is a group. A bucket
    that then lies in one group is done. In the others each pair of sets from different groups is still compared: in small
    buckets as listed pairs, in large ones block by block inside a task, where only sets outside the bucket's largest
    group have to look at the rest. Nothing is left out, and no bucket's pairs become rows but the small ones'.
    """
    rows = sets.select("id", "n", F.explode("bands").alias("key"))
    buckets = stored(rows.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = stored(spread_join(rows, "key", "id", buckets.withColumnRenamed("key", "_k"), "_k", buckets.select("key", F.col("m").alias("count"))).drop("_k"))
    wanted = sets.join(members.select(F.col("id").alias("_id")).distinct(), F.expr("id = _id")).select("id", "at", "set_key")
    grams = set_grams(docs, stored(wanted))
    first = stored(pair_links(stored(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()), grams))
    roots = star_components(first)
    placed = stored(members.join(roots, F.expr("id = node"), "left").select("key", "id", "n", "lead", "m", F.coalesce("root", "id").alias("comp")))
    groups = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    apart = groups.groupBy(F.col("key").alias("_k")).agg(F.sum("w").alias("w"), F.max(F.struct("c", "w", "comp")).alias("main"), F.count(F.lit(1)).alias("groups"))
    apart = stored(apart.where("groups > 1").select("_k", F.col("main.comp").alias("main"), F.expr(f"cast((w - 1) div {targets} as int)").alias("tn"), F.expr(f"cast((w - main.w - 1) div {pivots} as int)").alias("pn")))
    left = stored(spread_join(placed, "key", "id", apart, "_k").drop("_k"))
    few = left.where(F.col("m") <= small_bucket)
    other = few.select(F.col("key").alias("_k"), F.col("id").alias("b"), F.col("comp").alias("_c"))
    pairs = few.where("id <> lead").join(other, F.expr("key = _k and id < b and comp <> _c")).select(F.col("id").alias("a"), "b").distinct()
    many = left.where(F.col("m") > small_bucket)
    looked = many.select("key", "id", "comp", F.lit(False).alias("pivot"), F.explode(F.sequence(F.lit(0), "pn")).alias("i"), F.expr("cast(pmod(xxhash64(id), tn + 1) as int)").alias("j"))
    lookers = many.where("comp <> main").select("key", "id", "comp", F.lit(True).alias("pivot"), F.expr("cast(pmod(xxhash64(id), pn + 1) as int)").alias("i"), F.explode(F.sequence(F.lit(0), "tn")).alias("j"))
    met = looked.unionByName(lookers).join(grams.withColumnRenamed("id", "_id"), F.expr("id = _id")).drop("_id")
    blocks = met.groupBy("key", "i", "j").applyInArrow(_joined, "a long, b long")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(pair_links(stored(pairs), grams)).unionByName(blocks)


def minhash_groups(docs: DataFrame, small_bucket: int = SMALL, targets: int = TARGETS, pivots: int = PIVOTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct pairs of neighbouring words, of a text of one word that word. Documents link where
    PERCENT of the union of their sets is shared; candidates share a band of the min-max signature, links are confirmed
    on whole sets (of 64-bit hashes; two texts of 20,000 words would count a shingle too many once in 10^10). Equal sets
    are compared once. Of texts of any length every word counts. Null, empty and wordless texts have no set and are alone
    with their own id. A null id is a component's only where it has no other; `kept` is true where doc_id and component_id
    are equal or both null, so rows that repeat an id that is kept are kept. Other columns are ignored; an empty table
    gives no rows.
    """
    prints = cut(_texts(docs).mapInArrow(_signed, "doc_id long, at long, n long, set_key binary, bands array<long>"))
    some = prints.where("n > 0")
    # Copies have the same bands: any row's will do.
    sets = some.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("at").alias("at"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()))
    roots = star_components(stored(set_links(docs, sets, small_bucket, targets, pivots)))
    rooted = stored(sets.select("id", "set_key", "least").join(roots, F.expr("id = node"), "left").select("set_key", "id", "least", F.coalesce("root", "id").alias("root")))
    ids = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    ids = stored(spread_join(rooted, "root", "id", ids, "_root").select(F.col("set_key").alias("_key"), "component_id"))
    found = spread_join(some.select("doc_id", "n", "set_key"), "set_key", "doc_id", ids, "_key")
    every = found.select("doc_id", "n", "component_id").unionByName(prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


#: DuckDB SQL of `op12_minhash` by brute force: every two documents that share a shingle.
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE_WORD}') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
  g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
    GROUP BY 1, 2 HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))
