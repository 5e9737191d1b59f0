"""A corpus pipeline over documents: toxic documents go, one of each group of near duplicates stays, sources
are mixed to target weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; a row travels whole in one column, so that other
columns can have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, mixing, neardup, toxicity
from lumenfold.llm.common import written

#: SQL can't express the trained classifier or the random rounding; a brute-force version of all stages is a test.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model learns from the labelled rows among docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; five-word shingles, similarity of 0.8 or more.

    Blank texts and null ids are linked with nothing and stay. Rows that repeat an id: the one of the smallest hash stays.
    """
    kept = neardup.near_duplicates(docs, width=5, threshold=(80, 100)).where("kept").select(F.col("id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("*").alias("hash"), F.struct("*").alias("row"))
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("hash").alias("least"), F.count(F.lit(1)).alias("rows"))
    kept = written(first.join(kept, F.col("id") == F.col("kept_id"), "left_semi").withColumnRenamed("id", "kept_id"))
    one = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("least")))
    again = one.where("rows > 1").dropDuplicates(["id"])  # equal rows
    parts = [one.where("rows = 1"), again, rows.where("id IS NULL")]
    return reduce(DataFrame.unionByName, [part.select("row") for part in parts]).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies (none to three) of each document as the mix takes."""
    size = mixing.word_count(F.col("text"))
    taken = mixing.mix_sources(docs, size).groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = written(taken.select(*[F.col(c).alias(f"of_{c}") for c in ("id", "source", "size")], "copies", "rows"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source"), size.alias("size"), F.xxhash64("text").alias("pick"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    # ids are distinct after the stage before; null ids of one source and size share their copies evenly
    share = F.floor(F.col("copies") / F.col("rows")) + (F.pmod("pick", "rows") < F.col("copies") % F.col("rows")).cast("long")
    copies = keyed.join(taken, same).withColumn("n", share).where("n > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.encode_texts(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mix_sources", mix), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
