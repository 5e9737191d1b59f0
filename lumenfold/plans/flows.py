"""The whole flows: benchmark (fuse, measure, append what is missing) and helpers for picking scenes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import metrics
from ..operators.morphology import co_partition
from ..operators.ordering import numbered
from ..sources.staging import exists, staged

Method = Callable[[DataFrame], DataFrame]
RECORD = ("EN", "SD", "FE", "MG", "MI_vis", "MI_ir", "SF", "SSIM", "SCD", "FMI", "Qabf", "Nabf", "Q0", "QW", "QE", "VIF")
FUSED = "pair_id long, y int, x int, vis double, ir double, f double, method string, batch int"
RESULTS = "pair_id long, " + ", ".join(f"{m} double" for m in RECORD) + ", method string, batch int"
FAILURES = "error string, pairs long, method string"
BATCHES = "pair_id long, batch int"


def numbered_pairs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, rn from 1 in key order."""
    return numbered(pairs.select(key), key)


def missing_results(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't among the results yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


class Benchmark:
    """Fuses and measures every method on every pair, and keeps what is done in a folder that all executors share.

    The folder holds ``batches`` (each pair's batch, given once), ``fused`` and ``results`` (a Parquet partition per
    method and batch) and ``failures`` (the last error of each method that has pairs missing). A partition is replaced as a whole and
    appears only when its job is committed, so a run that was ended at any place is gone on with by running it again:
    an anti join tells the (method, pair) without a result, their batches are done anew, and nothing else is touched.
    """

    def __init__(self, spark: SparkSession, folder: str, batch_pairs: int = 256, digits: int = 9):
        self.spark, self.folder, self.batch_pairs, self.digits = spark, folder, batch_pairs, digits

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the folder; empty before its first partition."""
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        return self.table("results", RESULTS)

    def failures(self) -> DataFrame:
        return self.table("failures", FAILURES)

    def _put(self, df: DataFrame, name: str, *partitions: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.folder}/{name}")

    def batches(self, px: DataFrame) -> DataFrame:
        """pair_id, batch: pairs that are new get the batches after the last one, in the order of their ids."""
        known = self.table("batches", BATCHES)
        new = missing_results(px.select("pair_id").distinct(), known, ["pair_id"])
        last = known.agg(F.max("batch")).first()[0]
        batch = F.floor((F.col("rn") - 1) / self.batch_pairs).cast("int") + (0 if last is None else last + 1)
        new = numbered_pairs(new).select("pair_id", batch.alias("batch"))
        if not new.isEmpty():
            self._put(new, "batches", "batch")
        return self.table("batches", BATCHES)

    def _todo(self, batches: DataFrame, methods: list[str], name: str) -> dict[str, list[int]]:
        """method -> batches in which a pair isn't in the table: a row for each method and batch, never one for each pair."""
        wanted = batches.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
        done = self.table(name, FUSED if name == "fused" else RESULTS).select("method", "pair_id").distinct()
        rows = missing_results(wanted, done, ["method", "pair_id"]).groupBy("method").agg(F.sort_array(F.collect_set("batch")).alias("batches"))
        return {r["method"]: r["batches"] for r in rows.collect()}

    def fuse(self, px: DataFrame, methods: dict[str, Method]) -> None:
        """Writes the fused pixels that are missing, a job for each method; a method that fails is noted, and the others go on."""
        batches = self.batches(px)
        todo = self._todo(batches, list(methods), "results")
        fused = self._todo(batches, list(methods), "fused")
        px = staged(px.join(batches, "pair_id"))
        for name, wanted in todo.items():
            again = sorted(set(wanted) & set(fused.get(name, [])))
            if not again:
                continue
            some = px.where(F.col("batch").isin(again))
            error = None
            try:
                out = methods[name](some.drop("batch")).withColumn("f", rounded(F.col("f"), self.digits))
                out = out.join(batches, "pair_id")
                self._put(out.withColumn("method", F.lit(name)), "fused", "method", "batch")
            except Exception as failed:  # noqa: BLE001  whatever a method raises
                error = str(failed).splitlines()[0][:500]
            left = [(error, some.select("pair_id").distinct().count(), name)] if error else []
            if left or exists(self.spark, f"{self.folder}/failures/method={name}"):
                self._note(name, left)

    def _note(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, FAILURES).drop("method").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/failures/method={name}")

    def measure(self, px: DataFrame, methods: list[str], with_vif: bool = True) -> None:
        """Measures the fused pixels that have no result yet, of all methods in one job."""
        todo = self._todo(self.table("batches", BATCHES), methods, "results")
        todo = {name: batches for name, batches in todo.items() if exists(self.spark, f"{self.folder}/fused/method={name}")}
        if not todo:
            return
        wanted = F.lit(False)
        for name, batches in todo.items():
            wanted = wanted | ((F.col("method") == name) & F.col("batch").isin(batches))
        keys = ("method", "batch", "pair_id")
        fused = self.table("fused", FUSED).where(wanted)
        fused = staged(co_partition(fused, keys), keys) if with_vif else fused  # two passes read it then
        found = metrics.evaluate(fused, with_vif, keys)
        found = found if with_vif else found.withColumn("VIF", F.lit(None).cast("double"))
        self._put(found.select("pair_id", *RECORD, "method", "batch"), "results", "method", "batch")

    def run(self, px: DataFrame, methods: dict[str, Method], with_vif: bool = True) -> DataFrame:
        """method, pair_id and the record of all that is done after this run."""
        self.fuse(px, methods)
        self.measure(px, list(methods), with_vif)
        return self.results().select("method", "pair_id", *RECORD)
