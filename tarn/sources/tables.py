"""Tables of a dataset folder, spread over the cores, and the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on.  A scan with fewer splits than there are cores (a small
    file of one row group) is dealt to all of them; a larger one is left as it is and not shuffled."""
    rows, cores = read_table(spark, folder, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/{name}.parquet")
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    rows = spark.readStream.schema(read_table(spark, folder, name).schema)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else rows.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is not set, the warehouse of a local session.  A cluster has to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file at ``path``, to tell a table that has changed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(at)))
