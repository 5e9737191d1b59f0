"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset, and Spark runs
    in one process, a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there, and lost
    executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenfold-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(id_column.cast("string")) % n


def lower_ascii(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """texts in order, in lists of about so many characters: what is made of them is held for one list only."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def ids_of(texts) -> list[int | None]:
    """Ids that travelled as text, so that a null among them leaves large ones exact."""
    return [None if t is None else int(t) for t in texts]
