"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables. Where none is named, a local session gets one of its own; a cluster
    must name one, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shelfscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shelfscope/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores, by keys where some are named: a small file is read by one task or few, and small shuffles become one
    partition, however long their rows take."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def finely(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into 16 parts for each part of its input, which is of limited size: what a task holds doesn't grow with the table."""
    return df.repartition(16 * df.rdd.getNumPartitions(), *keys)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files through the file system that holds it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    for path in {f.rpartition("/")[0].split("/batch=")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, path)
