"""Sessions longer than a task: the same as windows over whole sessions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import deadreckon as D
from wayline.operators import scans
from wayline.operators import sequence as S

KEYS = ["session_id"]


@pytest.fixture(scope="module")
def steps(spark):
    """One session of 4,000 rows, one of a chunk's length exactly, one of a row; fixes are rare, at chunk edges too."""
    rows = spark.createDataFrame([("long", 4000), ("even", 500), ("one", 1)], "session_id string, n long")
    rows = rows.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    fix = (F.col("i") % 1500 == 499) | (F.col("i") % 700 == 0) | F.col("i").between(2490, 2510)
    return rows.select(
        "session_id", "i", (F.col("i") * 0.5 - (F.col("i") % 5 == 3).cast("int")).alias("t_s"), F.sin(F.col("i") / 9).alias("gyro"),
        (3 + F.cos(F.col("i") / 40)).alias("speed"), (51.0 + F.col("i") / 1e5).alias("gt_lat"), F.when((F.col("i") % 1400 != 0) | (F.col("i") == 0), F.col("i") / 1e5).alias("gt_lon"),
        F.lit(30.0).alias("h0"), (~fix).alias("is_blackout"),
    ).persist()


def track(steps, chunk):
    rows = D.headings(D.with_dt(steps, KEYS, chunk=chunk), "gyro", "h0", KEYS, chunk=chunk)
    return D.positions(rows, "speed", KEYS, chunk=chunk)


@pytest.mark.parametrize("chunk", [1, 7, 500])
def test_positions_equal_those_of_whole_sessions(steps, chunk):
    whole, parts = ({(r["session_id"], r["i"]): r for r in track(steps, c).collect()} for c in (None, chunk))
    assert whole.keys() == parts.keys() and len(whole) == 4501
    for at, w in whole.items():
        p = parts[at]
        assert p["dt"] == w["dt"]
        assert abs(p["lat"] - w["lat"]) < 1e-10 and abs(p["lon"] - w["lon"]) < 1e-10


def test_the_session_is_spread_over_tasks(spark, steps):
    """The long session's rows meet in windows of 500, dealt over many partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = track(steps, 100).where("session_id = 'long'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert len(found) == 8 and sum(r["count"] for r in found) == 4000 and max(r["count"] for r in found) < 2000


@pytest.mark.parametrize("chunk", [2, 9, 500])
def test_a_clock_with_resets(steps, chunk):
    rows = steps.select("session_id", F.col("i").alias("seq"), ((F.col("i") % 23) * 100.0).alias("time_ms"))
    whole, parts = (sorted(S.unwrap_resets(rows, chunk=c).collect()) for c in (None, chunk))
    assert whole == parts
    with pytest.raises(ValueError):
        S.unwrap_resets(rows, chunk=1)


def test_numbers_of_shuffled_rows_and_ties(spark, steps):
    """Half of the rows tie on the whole order, in one session."""
    rows = steps.select("session_id", F.least("i", F.lit(2000)).alias("at"), "i").orderBy(F.xxhash64("i"))
    found = scans.numbered_across(rows, ["at"]).collect()
    for session, n in (("long", 4000), ("even", 500), ("one", 1)):
        mine = [r for r in found if r["session_id"] == session]
        assert sorted(r["seq"] for r in mine) == list(range(n))
        assert all(r["seq"] == r["i"] for r in mine if r["at"] < 2000)
    assert scans.numbered_across(rows.where("false"), ["at"]).count() == 0


def test_running_values_with_nulls_and_empty(spark, steps):
    rows = steps.select("session_id", "i", F.when(F.col("i") % 3 == 1, F.col("i")).alias("v"))
    w = Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.withColumns({"s": F.sum("v").over(w), "f": F.first("v").over(w)})
    found = scans.running(rows, KEYS, "i", 50, {"s": F.col("v")}, {"f": "v"})
    assert found.exceptAll(wanted).count() == 0 and found.count() == 4501
    assert scans.running(rows.where("false"), KEYS, "i", 50, {"s": F.col("v")}).count() == 0
