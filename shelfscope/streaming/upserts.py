"""A table of the latest row of each key that a stream keeps up to date: a log of batches, read by key and compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import latest
from ..sources.work import delete_folder


def upsert_stream(updates: DataFrame, path: str, *, key: str, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes the updates of a stream to a log of batches under path.

    Each batch is written to the folder of its number, its last row of each key alone, over whatever an attempt that failed has left
    there: a batch that is repeated after a restart changes nothing. Rows with a null key are left out; of rows that share key and
    order any one stays. The work of a batch is that of its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch.where(F.col(key).isNotNull()), key, order).select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, *, key: str, order: str) -> DataFrame:
    """The latest row of each key of a log by order, the one of the later batch where two have the same."""
    log = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in log.columns if c != "batch"]
    place = F.struct(F.col(order), F.col("batch"))
    return latest(log.withColumn("__place", place), key, "__place").select(columns)


def compact(spark: SparkSession, path: str, *, key: str, order: str) -> None:
    """Put all finished batches of a log into the folder of the last of them; no other writer may run.

    The merged rows are written beside the log first, so at each moment either the batches or the merged rows are whole, and a
    compaction that was broken off can be run again.
    """
    done = sorted(r.batch for r in spark.read.option("basePath", path).parquet(path).select("batch").distinct().collect())
    if len(done) < 2:
        return
    merged = f"{path}-merged"
    current(spark, path, key=key, order=order).write.mode("overwrite").parquet(merged)
    spark.read.parquet(merged).write.mode("overwrite").parquet(f"{path}/batch={done[-1]}")
    for number in done[:-1]:
        delete_folder(spark, f"{path}/batch={number}")
    delete_folder(spark, merged)
