"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import stored


def spread_join(
    rows: DataFrame, key: str, by: str, once: DataFrame, once_key: str, counts: DataFrame | None = None, total: int | None = None
) -> DataFrame:
    """rows joined with `once`, which has one row for each key: keys with far more rows than a partition's share are dealt
    by `by` to several partitions, and their row of `once` goes to each.

    With P partitions, keys of more than a share (a P-th of the rows) are dealt, into parts of half a share; there are at
    most P of them, so they go through the driver, and without any the join is a plain one. `counts`: key and `count`, and
    `total`, the number of rows, where they are known already.
    """
    spark = rows.sparkSession
    share = max(64, (rows.count() if total is None else total) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.groupBy(key).count() if counts is None else counts
    hot = counts.where(F.col("count") >= 2 * share).select(F.col(key).alias("_hot"), F.expr(f"cast(count div {share} as int)").alias("_parts"))
    found = hot.collect()  # at most P
    same = F.col(key) == F.col(once_key)
    if not found:
        return rows.join(once, same)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).otherwise(0))
    right = once.join(hot, F.col(once_key) == F.col("_hot"), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    left, right = left.drop("_hot", "_parts"), right.drop("_hot", "_parts")
    return left.join(right, same & (F.col("_salt") == F.col("_at"))).drop("_salt", "_at")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. One row (node, root) per node that has an edge to a smaller one at the end.

    A root is its component's smallest node and has no row. Each step groups with map-side minima and joins them back with
    hubs dealt to several tasks, so a hub's edges are never gathered in one place; every step's edges are written to the
    checkpoint folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(now)  # written, not checkpointed: the planner then sees real sizes, not products over all steps
    before, found = None, _signature(now)
    while found != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = spread_join(both.where("v > u"), "u", "v", least, "k", total=found[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v"))  # repeats go with the small step's
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = spread_join(large, "u", "v", least, "k", total=found[0])  # a hub above its neighbours keeps all its edges to here
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
        before, found = found, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
