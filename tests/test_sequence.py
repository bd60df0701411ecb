"""Joins by time over long sessions."""

import bisect
import random
import time

from pyspark.sql import functions as F

from wayline.operators import sequence as S


def test_nearest_as_of_matches_brute_force(spark):
    rng = random.Random(3)
    left = [("a", i, rng.randrange(60) / 2) for i in range(40)] + [("b", 99, 5.0), ("none", 98, 1.0)]
    right = [("a", rng.randrange(60) / 2, rng.randrange(5)) for _ in range(25)] + [("b", 3.0, 7), ("b", 7.0, 1)]
    found = S.nearest_as_of(
        spark.createDataFrame(left, "session_id string, n int, at double"), spark.createDataFrame(right, "session_id string, t double, v int"), "at", "t", ["v"]
    )
    for r in found.collect():
        near = sorted((abs(r["at"] - t), t, v) for s, t, v in right if s == r["session_id"])
        assert (r["matched_t"], r["matched_v"]) == (near[0][1:] if near else (None, None))
    assert found.count() == len(left)


def test_a_long_session(spark):
    """One session of 100,000 rows: the frames grow with it, they aren't gone through anew for every row."""
    rows = spark.range(100_000).select(F.lit("s").alias("session_id"), F.col("id"), (F.col("id") + (F.col("id") * 7 % 5) / 10).alias("t"))
    began = time.perf_counter()
    found = S.nearest_as_of(rows.select("session_id", "id", (F.col("t") - 5.3).alias("at")), rows, "at", "t", ["id"])
    got = {r["id"]: r["matched_id"] for r in found.select("id", "matched_id").collect()}
    assert time.perf_counter() - began < 30
    times = [i + (i * 7 % 5) / 10 for i in range(100_000)]
    for i in range(0, 100_000, 997):
        want = times[i] - 5.3
        k = bisect.bisect(times, want)
        best = min((j for j in (k - 1, k) if 0 <= j < len(times)), key=lambda j: (abs(times[j] - want), j))
        assert abs(times[got[i]] - want) <= abs(times[best] - want) + 1e-9
