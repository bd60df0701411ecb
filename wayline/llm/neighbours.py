"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, table
from wayline.llm.prefix import running_totals

#: Neighbours asked for; the queries are the ids that it divides.
NEAREST, EVERY = 20, 20
#: Curves, projected dimensions and bits of each (a key has at most 62 bits); queries met with one block.
CURVES, DIMENSIONS, KEY_BITS, CHUNK = 16, 8, 7, 4096
#: A block has as many vectors as a window reaches either side, within these bounds, so a query meets little more than its
#: windows.
LEAST_BLOCK, MOST_BLOCK = 128, 1024
#: Queries whose true neighbours set the window, and the share of those neighbours that it must reach.
TRIED, REACHED = 64, 0.95
SEED = 90210


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (0 to 2**bits - 1)."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # undo the curve's turns, from the largest cells down
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> level) & 1)
    return key


class Curves:
    """The projections and shifts of all curves, for vectors of one length."""

    def __init__(self, length: int, largest: float, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = KEY_BITS):
        rng = np.random.default_rng([SEED, length])
        dimensions = min(dimensions, length + 1)
        self.largest, self.bits = largest, bits
        self.planes = [np.linalg.qr(rng.normal(size=(length + 1, dimensions)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dimensions) for _ in range(curves)]
        self.spread = np.sqrt(largest / length)

    def keys(self, vectors: np.ndarray, asking: bool) -> Iterator[np.ndarray]:
        """The largest inner product is the nearest point once every vector is lifted to the largest norm in one more
        dimension, in which the queries are 0."""
        lift = np.zeros(len(vectors)) if asking else np.sqrt(np.maximum(self.largest - (vectors**2).sum(1), 0))
        lifted = np.c_[vectors, lift]
        for plane, shift in zip(self.planes, self.shifts, strict=True):
            even = 0.5 * (1 + np.tanh(0.85 * (lifted @ plane) / self.spread))
            cells = np.minimum((even + shift) * 0.5 * (1 << self.bits), (1 << self.bits) - 1).astype(np.int64)
            yield hilbert_keys(cells, self.bits)


@lru_cache(maxsize=8)
def curves_of(length: int, largest: float) -> Curves:
    return Curves(length, largest)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length."""
    lengths = batch.column("length").to_numpy()
    for n in np.unique(lengths).tolist():
        yield n, batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


def _keyed(largest: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for length, batch in _by_length(whole):
                vectors, ids, first = _matrix(batch.column("vector")), batch.column("gid").to_numpy(), batch.column("first").to_numpy()
                asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                for asking, rows in ((False, np.arange(len(ids))), (True, np.flatnonzero(asks))):
                    for curve, keys in enumerate(curves_of(length, largest[length]).keys(vectors[rows], asking)):
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, curve, np.int32)), pa.array(keys), pa.array(first[rows]), pa.array(ids[rows]),
                                pa.array(np.full(n, asking)), pa.array(np.full(n, int(not asking), np.int64)),
                            ],
                            ["length", "curve", "key", "first", "gid", "asking", "is_data"],
                        )

    return run


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors that take part, once each: gid, length, first (the smallest id), vector, ids (the smallest NEAREST + 1
    of its rows), asks; and the queries: vec_id, gid, a row for each row that asks.

    Of a vector's copies only the smallest ids can be among the nearest, so large groups of copies shrink before the
    shuffle (the rank limit is applied by every task to its own rows first).
    """
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = embeddings.where("vec_id is not null and embedding is not null").where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_n", rank).where(F.col("_n") <= NEAREST + 1)
    ids = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where(F.col("vec_id") % EVERY == 0)
    asks = asking.groupBy(F.col("vector").alias("_v")).agg(F.lit(True).alias("asks"))
    groups = ids.join(asks, F.expr("vector = _v"), "left").select(
        F.monotonically_increasing_id().alias("gid"), F.size("vector").alias("length"), F.col("ids")[0].alias("first"), "vector", "ids",
        F.coalesce("asks", F.lit(False)).alias("asks"),
    )
    groups = cut(groups)
    own = groups.where("asks").select("gid", F.col("vector").alias("_v"))
    return groups, asking.join(own, F.expr("vector = _v")).select("vec_id", "gid")


def curve_places(groups: DataFrame) -> DataFrame:
    """length, curve, gid, first, asking, place, n: where each vector and query stands on each curve among the n vectors of
    its length. One row for each vector length comes to the driver."""
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    spaces = groups.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).orderBy("length").collect()
    keyed = groups.select("gid", "length", "first", "vector", "asks").mapInArrow(
        _keyed({r["length"]: r["largest"] for r in spaces}), "length int, curve int, key long, first long, gid long, asking boolean, is_data long"
    )
    lined = running_totals(keyed, [F.col(c) for c in ("length", "curve", "key", "asking", "gid")], "is_data")
    before, rows = 0, []
    for r in spaces:
        rows.append((r["length"], r["n"], before))
        before += r["n"] * CURVES
    known = groups.sparkSession.createDataFrame(rows, "_length int, n long, _before long")
    lined = lined.join(F.broadcast(known), F.expr("length = _length"))  # one row for each vector length
    return cut(lined.select("length", "curve", "gid", "first", "asking", "n", (F.col("_start") - F.col("_before") - F.col("curve") * F.col("n")).alias("place")))


def _brute(asked: list):
    """The nearest of a partition to each of a few queries: (gid, length, vector)."""
    held = {n: [r for r in asked if r["length"] == n] for n in {r["length"] for r in asked}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for length, batch in _by_length(whole) if whole.num_rows else ():
                if length not in held:
                    continue
                ids, own = np.array([r["gid"] for r in held[length]]), batch.column("gid").to_numpy()
                s = np.array([r["vector"] for r in held[length]]) @ _matrix(batch.column("vector")).T
                s[ids[:, None] == own[None, :]] = -np.inf
                scores, found = best.get(length, (np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)))
                scores, found = np.c_[scores, s], np.c_[found, np.broadcast_to(own, s.shape)]
                at = np.argsort(-scores, axis=1, kind="stable")[:, :NEAREST]
                best[length] = np.take_along_axis(scores, at, 1), np.take_along_axis(found, at, 1)
        for length, (scores, found) in best.items():
            ids, keep = np.array([r["gid"] for r in held[length]]), np.isfinite(scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(ids[:, None], found.shape)[keep]), pa.array(found[keep]), pa.array(scores[keep])], ["q", "gid", "score"]
            )

    return run


def window_width(groups: DataFrame, places: DataFrame, tried: int = TRIED, reached: float = REACHED) -> int:
    """The distance in places within which, on its best curve, a share `reached` of true neighbours lies.

    `tried` queries chosen by hash are compared with every vector, and the places of them and their neighbours (at most
    tried * (NEAREST + 1) vectors) on all curves are looked up. The same rule holds at every size.
    """
    asked = groups.where("asks").orderBy(F.xxhash64("gid"), "gid").limit(tried).select("gid", "length", "vector").collect()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    near = groups.select("gid", "length", "vector").mapInArrow(_brute(asked), "q long, gid long, score double")
    pairs = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= NEAREST).select("q", "gid").collect() if asked else []
    if not pairs:
        return 1
    known = groups.sparkSession.createDataFrame([(g,) for g in {g for p in pairs for g in p}], "_g long")
    rows = places.join(F.broadcast(known), F.expr("gid = _g")).select("curve", "gid", "asking", "place").collect()
    place = {(r["curve"], r["gid"], r["asking"]): r["place"] for r in rows}
    curves = {r["curve"] for r in rows}
    away = [min(abs(place[c, q, True] - place[c, g, False]) for c in curves) for q, g in pairs]
    return int(np.quantile(away, reached, method="higher")) + 1


def visited_blocks(places: DataFrame, width: int, block: int) -> DataFrame:
    """The places with `blocks`: a vector's own, and those that a query's window of `width` places either side touches."""
    reach = f"sequence(greatest(place - {width}, 0) div {block}, greatest(least(place + {width}, n - 1), 0) div {block})"
    return places.withColumn("blocks", F.when(F.col("asking"), F.expr(reach)).otherwise(F.array(F.expr(f"place div {block}"))))


def best_columns(scores: np.ndarray, most: int) -> np.ndarray:
    """Which columns are among each row's `most` largest finite values; of equal ones at the end the leftmost."""
    most = min(most, scores.shape[1])
    least = -np.partition(-scores, most - 1, axis=1)[:, most - 1 :][:, :1]
    keep = scores >= least
    if (keep.sum(1) > most).any():
        over, even = scores > least, scores == least
        keep = over | (even & (even.cumsum(1) <= most - over.sum(1)[:, None]))
    return keep & np.isfinite(scores)


def _block_nearest(group: pa.Table) -> pa.Table:
    """A block's nearest to each query that visits it; equally near ones by their smallest ids."""
    group = group.sort_by([("first", "ascending"), ("gid", "ascending")])
    asking = group.column("asking").to_numpy().astype(bool)
    vectors, ids, first = _matrix(group.column("vector")), group.column("gid").to_numpy(), group.column("first").to_numpy()
    data, own, least = vectors[~asking], ids[~asking], first[~asking]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in np.array_split(np.flatnonzero(asking), max(1, asking.sum() // 256)) if len(own) else []:
        scores = vectors[at] @ data.T
        scores[ids[at][:, None] == own[None, :]] = -np.inf  # copies are added later
        row, column = np.nonzero(best_columns(scores, NEAREST + 1))
        found.append((ids[at][row], own[column], least[column], scores[row, column]))
    q, g, f, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"q": q, "gid": g, "first": f, "score": s})


def nearest(embeddings: DataFrame, block: int | None = None, reached: float = REACHED) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST found vectors of largest inner product for every query.

    Vectors are projected and ordered along each curve; a range-partitioned sort gives every vector and query its place.
    A query visits the blocks of `block` vectors (if not given, by the window) that its window on each curve touches, and a block's vectors and its
    visitors (in chunks of about CHUNK) meet in one group of bounded size. What the curves find is merged, scored again
    on the original vectors in one fixed order of summation, and expanded to the ids of equal vectors.

    Null ids and vectors null, zero or with null or non-finite components take no part. Vectors of another length have no
    inner product with a query, so each length is searched by itself. Repeated rows are candidates each, and queries each:
    a query leaves out its own row only. Ties go to the smaller vec_id. Other columns are ignored.
    """
    groups, queries = distinct_vectors(embeddings)
    places = curve_places(groups)
    width = window_width(groups, places, reached=reached)
    block = block or min(max(width, LEAST_BLOCK), MOST_BLOCK)
    most = places.groupBy("length", "curve").agg(F.count_if("asking").alias("asked"), F.max("n").alias("n"))
    visitors = most.agg(F.max(F.col("asked") * F.least((2 * width + block) / F.col("n"), F.lit(1.0)))).first()[0] or 0
    chunks = max(1, -int(-visitors // CHUNK))
    chunk = F.when(F.col("asking"), F.array(F.pmod(F.xxhash64("gid"), F.lit(chunks)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(chunks - 1)))
    dealt = visited_blocks(places, width, block).withColumn("block", F.explode("blocks")).withColumn("chunk", F.explode(chunk))
    vectors = groups.select(F.col("gid").alias("_g"), "vector")
    keys = ["length", "curve", "block", "chunk"]
    met = dealt.join(vectors, F.expr("gid = _g")).select(*keys, "gid", "first", "asking", "vector")
    found = met.groupBy(*keys).applyInArrow(_block_nearest, "q long, gid long, first long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first", "gid")
    merged = found.groupBy("q", "gid", "first").agg(F.max("score").alias("score"))
    merged = merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= NEAREST + 1).select("q", "gid")
    own = groups.where("asks").select(F.col("gid").alias("q"), "gid")  # a query's own copies
    asking = groups.where("asks").select(F.col("gid").alias("_q"), F.col("vector").alias("_qv"))
    other = groups.select(F.col("gid").alias("_g"), F.col("vector").alias("_gv"), "ids")
    pairs = merged.unionByName(own).join(asking, F.expr("q = _q")).join(other, F.expr("gid = _g"))
    score = F.aggregate(F.zip_with("_qv", "_gv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    each = pairs.select("q", (F.col("q") == F.col("gid")).alias("same"), score.alias("score"), F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "same")
    top = each.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= NEAREST + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score", "same"))).alias("_found"))
    asked_of = queries.withColumnRenamed("vec_id", "query_id").join(lists, F.expr("gid = q"))
    # A query that isn't among the smallest ids of its own vector is in no list, and loses nobody.
    own_at = F.array_position(F.transform("_found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("_found", lambda x: x["_n"] != own_at), 1, NEAREST)
    ranked = asked_of.select("query_id", F.posexplode(others).alias("_at", "_x"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
