"""Tables between steps, in the folder that all executors share.

A staged table ends a lineage: later plans are short, nothing is worked out twice, and a lost executor costs its tasks
only. It is dealt into buckets by its keys, so that windows and groups over supersets of the keys need no shuffle after
the scan; the number of buckets is that of shuffle partitions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, keys: tuple[str, ...] = ("pair_id",), shuffle: bool = True) -> DataFrame:
    """df, written in buckets by its keys and read again.

    Without a shuffle every task writes its own part of each bucket: more files, but the rows move once, as columns with
    dictionaries instead of whole rows, which takes a fraction of the disk.
    """
    spark = df.sparkSession
    name, buckets = f"staged_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, *keys) if shuffle else df  # a task then has one bucket; where rows lie so already, this moves nothing
    writer = rows.write if shuffle else rows.write.option("compression", "zstd")
    writer.bucketBy(buckets, *keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
