"""Sums of long vectors over all rows, added up in the tasks and then in groups of tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_sum(vector: np.ndarray) -> pa.RecordBatch:
    """What a task hands on: its vector, as one row of `vector`."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(vector, np.float64).tobytes()], pa.binary())], ["vector"])


def few_tasks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The same rows in two tasks a core at most, so that the vectors of a sum follow the cores and not the input; how many
    tasks that is."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(tasks), tasks


def upper(square: np.ndarray) -> np.ndarray:
    """A symmetric matrix's entries from the diagonal up, as a vector."""
    return square[np.triu_indices(len(square))]


def symmetric(entries: np.ndarray, d: int) -> np.ndarray:
    """The symmetric matrix that `upper` gave the entries of."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = entries
    return out + np.triu(out, 1).T


def _added(group: pa.Table) -> pa.Table:
    group = group.sort_by("part")
    total = np.zeros(0)
    for row in group.column("vector"):
        one = np.frombuffer(row.as_py())
        total = one.copy() if not total.size else total + one
    return pa.table({"g": group.column("g")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


def total(parts: DataFrame, tasks: int | None = None) -> np.ndarray:
    """The sum of float64 vectors of one length (`vector` as bytes, a row of each task), empty without any.

    With P partitions, about sqrt(P) of them are added at a time, so that many rows come to the driver; P is `tasks`, where
    that is known and less. Sums are taken in the partitions' order.
    """
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.isqrt(partitions if tasks is None else min(tasks, partitions)))
    numbered = parts.withColumn("part", F.spark_partition_id()).withColumn("g", F.col("part") % groups)
    found = numbered.groupBy("g").applyInArrow(_added, "g int, vector binary").collect()
    vectors = [np.frombuffer(r["vector"]) for r in sorted(found, key=lambda r: r["g"])]
    return np.sum(vectors, axis=0) if vectors else np.zeros(0)
