"""Numbers, lags and running values along sessions longer than a task should hold.

A session whose rows are counted from 0 is cut into chunks of so many rows, dealt by session and chunk. Lags reach back over
a chunk's start through copies of the rows before it; running values through the totals of the chunks before it, a row a
chunk. Keys and counts are never null. Sessions of one chunk get what a window over the session gives, longer ones the
same but for the order in which doubles are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.storage import cut


def numbered_across(df: DataFrame, order: list[str], key: str = "session_id", into: str = "seq") -> DataFrame:
    """Rows of each session counted from 0 in the given order, wherever the session is spread to.

    Rows are range-partitioned by session and order (checkpointed, so that bounds stay) and numbered in each partition. Only
    a partition's first session can go on from before, so the counts that shift numbers are at most one row a partition.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(key, *order, "_tie")
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select(key, "_part", F.sum("_n").over(before).alias("_before")).where("_before is not null")
    here = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order, "_tie")) - 1
    met = ranged.join(F.broadcast(shifts), [key, "_part"], "left")
    return met.withColumn(into, (here + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_tie", "_before")


def lagged(rows: DataFrame, keys: list[str], at: str, chunk: int, values: dict[str, tuple[str, int]]) -> DataFrame:
    """Add each name's column so many rows before, null where there is none."""
    reach = max(offset for _, offset in values.values())
    if chunk < reach:
        raise ValueError(f"chunks of {chunk} rows are shorter than a lag of {reach}")
    own = F.floor(F.col(at) / chunk).cast("long")
    copies = F.when(F.col(at) % chunk >= chunk - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "_chunk").orderBy(at)
    dealt = dealt.withColumns({name: F.lag(column, offset).over(w) for name, (column, offset) in values.items()})
    return dealt.where(F.col("_chunk") == own).drop("_chunk")


def running(
    rows: DataFrame, keys: list[str], at: str, chunk: int, sums: dict[str, Column], firsts: dict[str, str] | None = None, run: str | None = None
) -> DataFrame:
    """Add the sums of expressions up to each row, itself included, and the first values of columns.

    Where `run` names a column that never falls along a session, both start anew with each of its values. A chunk hands on
    only what belongs to its last run, so its totals stay one row however many runs it has.
    """
    firsts, part = firsts or {}, [*keys, "_chunk"]
    dealt = rows.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long"))
    number = F.col(run) if run else F.lit(0)
    ends = dealt.withColumn("_last", F.max(number).over(Window.partitionBy(*part))).where(number == F.col("_last")) if run else dealt
    totals = ends.groupBy(*part).agg(
        F.max(number).alias("_of"),
        *[F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()],
        *[F.min_by(F.struct(F.col(c).alias("v")), at).alias(f"_first_{n}") for n, c in firsts.items()],
    )
    so_far = Window.partitionBy(*keys, "_of").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    handed = [F.sum(f"_sum_{n}").over(so_far).alias(f"_sum_{n}") for n in sums] + [F.first(f"_first_{n}").over(so_far).alias(f"_first_{n}") for n in firsts]
    met = dealt.join(totals.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), "_of", *handed), part, "left")
    w = Window.partitionBy(*part, *([run] if run else [])).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("_of") == number
    out = {}
    for n, e in sums.items():
        here, before = F.sum(e).over(w), F.when(goes_on, F.col(f"_sum_{n}"))
        out[n] = F.coalesce(here + before, here, before)
    for n, c in firsts.items():
        out[n] = F.coalesce(F.when(goes_on, F.col(f"_first_{n}")), F.first(F.struct(F.col(c).alias("v"))).over(w))["v"]
    return met.withColumns(out).drop("_chunk", "_of", *[f"_sum_{n}" for n in sums], *[f"_first_{n}" for n in firsts])
