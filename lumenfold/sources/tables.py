"""Result tables and sweep state: CSV and JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A result table with a header; the schema is given, not guessed."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Records with doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*rounded).write.mode("overwrite").csv(path, header=True)


#: Sweep state as nested JSON: a map of configurations, each with its history.
STATE = "configs map<string, struct<t:int, evals:int, done:boolean, history:array<struct<it:int, gbest_fit:double, r:double, m:double>>>>"


def read_state(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """config, t, evals, done, it, gbest_fit, r, m of one document a file, or with lines one a line."""
    s = spark.read.json(path, schema=STATE, multiLine=not lines).select(F.explode("configs").alias("config", "s"))
    return s.select("config", "s.t", "s.evals", "s.done", F.explode_outer("s.history").alias("h")).select("config", "t", "evals", "done", "h.*")


def state_as_json(history: DataFrame) -> DataFrame:
    """One JSON text per configuration from (config, it, gbest_fit, r, m): its history in order."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("it", "gbest_fit", "r", "m"))), lambda x: x)
    return history.groupBy("config").agg(F.to_json(F.struct(F.max("it").alias("t"), h.alias("history"))).alias("state"))


def write_state(history: DataFrame, path: str, budget: int) -> None:
    """(config, it, gbest_fit, r, m) as documents that ``read_state`` reads, a line for each configuration.

    The folder appears as a whole: files are written aside and moved there when the job is committed.
    """
    h = F.transform(F.array_sort(F.collect_list(F.struct("it", "gbest_fit", "r", "m"))), lambda x: x)
    one = history.groupBy(F.col("config").cast("string").alias("config")).agg(F.max("it").cast("int").alias("t"), F.count(F.lit(1)).cast("int").alias("evals"), h.alias("history"))
    done = F.col("t") >= budget
    state = F.struct("t", "evals", done.alias("done"), F.transform("history", lambda x: F.struct(x["it"].cast("int").alias("it"), x["gbest_fit"].alias("gbest_fit"), x["r"].cast("double").alias("r"), x["m"].cast("double").alias("m"))).alias("history"))
    one.select(F.to_json(F.struct(F.create_map("config", state).alias("configs"))).alias("value")).write.mode("overwrite").text(path)
