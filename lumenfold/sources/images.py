"""Images of Spark's image source as pixel relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import from_byte, luma


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The images under a folder; files that can't be decoded are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)


def to_pixels(images: DataFrame, first_channel: bool = False) -> DataFrame:
    """origin, y, x, v in [0, 1]: gray value of one-channel images, luma of BGR ones, or their first channel."""
    i = images.select("image.origin", "image.width", "image.nChannels", "image.data")
    # one row of the image at a time, its bytes as two hex digits each
    line = F.col("width") * F.col("nChannels")
    i = i.withColumn("y", F.explode(F.sequence(F.lit(0), (F.length("data") / line).cast("int") - 1)))
    i = i.select("origin", "y", "width", "nChannels", F.hex(F.substring(F.col("data"), F.col("y") * line + 1, line)).alias("hex"))
    i = i.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = lambda k: F.conv(F.substring(F.col("hex"), (F.col("x") * F.col("nChannels") + k) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    gray = F.when(F.lit(first_channel) | (F.col("nChannels") == 1), at(0).cast("double")).otherwise(luma(at(0), at(1), at(2)))
    return i.select("origin", "y", "x", from_byte(gray).alias("v"))
