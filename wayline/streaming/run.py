"""Running a streaming plan over rows that are already there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.storage import checkpoint_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(rows: DataFrame, plan: Callable[[DataFrame], DataFrame], batches: int = 2, order: str = "ts_ns", end: DataFrame | None = None) -> DataFrame:
    """What a streaming plan gives for these rows: they are written as files, earlier rows first, read as a stream of
    about `batches` batches until none is left, and the output is read back. Input, state and output lie in the shared
    folder.

    `end` is written after all of them: a row that lets the watermark pass what still waits.

    Each batch is written as a file for each shuffle partition, dealt by device, and a trigger takes as many files. The
    stream runs in a session of its own, so that its state store is no setting of the caller's.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("_batch", F.ntile(batches).over(Window.partitionBy("device").orderBy(order)))
    numbered.write.partitionBy("_batch").parquet(f"{path}/rows")
    written = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    for n in range(1, batches + 1):  # one after another: the source takes older files first
        written.where(F.col("_batch") == n).select(rows.columns).repartition(files, "device").write.mode("append").parquet(f"{path}/in")
        if n == 1:
            each = max(1, len(spark.read.parquet(f"{path}/in").inputFiles()))  # partitions without a device write none
    if end is not None:
        end.select([F.col(f.name).cast(f.dataType) for f in rows.schema if f.name in end.columns] + [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in end.columns]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/in")
    query = plan(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
