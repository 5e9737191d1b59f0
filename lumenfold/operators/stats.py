"""Analysis of measurement tables in long form (subject, treatment, metric, value); no loops over metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi_square_tail, normal_two_sided, signed_rank_table
from .ordering import placed, quantiles


def to_long(wide: DataFrame, metrics: list[str], ids: tuple[str, ...] = ("subject", "treatment")) -> DataFrame:
    """One row per metric (A4)."""
    return wide.unpivot(list(ids), metrics, "metric", "value")


def directions(meas: DataFrame, lower_better: set[str]) -> Column:
    """1 where more is better, -1 where less is."""
    return F.when(F.col("metric").isin(*lower_better), -1.0).otherwise(1.0) if lower_better else F.lit(1.0)


def group_means(meas: DataFrame, digits: int | None = 4) -> DataFrame:
    """metric, treatment, mean (A1)."""
    mean = F.avg("value")
    return meas.groupBy("metric", "treatment").agg((F.round(mean, digits) if digits is not None else mean).alias("mean"))


def describe(meas: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum (A2)."""
    keys = ["metric", "treatment"]
    d = meas.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    d = d.join(quantiles(meas, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys, "left")
    return d.select(*keys, "n", "mean", "std", "min", "q1", "median", "q3", "max")


def box_stats(meas: DataFrame) -> DataFrame:
    """Quartiles and whiskers within 1.5 interquartile ranges."""
    d = describe(meas).select("metric", "treatment", "q1", "median", "q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = meas.join(d, ["metric", "treatment"]).where(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy("metric", "treatment", "q1", "median", "q3").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def average_rank(order: Column, *keys: str) -> Column:
    """Rank from 1 within keys, ties sharing the mean of their ranks."""
    ties = Window.partitionBy(*keys, order)
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def ranking(meas: DataFrame, lower_better: set[str], digits: int = 4) -> DataFrame:
    """treatment, avg_rank: mean over the metrics of the rank of the rounded means, best first (A5)."""
    m = group_means(meas, digits).withColumn("order", -directions(meas, lower_better) * F.col("mean"))
    r = m.withColumn("rank", average_rank(F.col("order"), "metric"))
    return r.groupBy("treatment").agg(F.round(F.round(F.avg("rank"), 3), 2).alias("avg_rank")).orderBy("avg_rank", "treatment")


def friedman(meas: DataFrame, k: int) -> DataFrame:
    """metric, chi2, p_value, significant over complete blocks of k treatments, ties corrected."""
    r = meas.withColumn("rank", average_rank(F.col("value"), "metric", "subject"))
    r = r.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("metric", "subject", "value")))
    per = r.groupBy("metric", "treatment").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    n = F.max("n")
    # where all values of all blocks are tied there is no statistic, and p is 1
    chi = F.try_divide(12.0 / (n * k * (k + 1)) * F.sum(F.col("r") * F.col("r")) - 3.0 * n * (k + 1), 1.0 - F.sum("t") / (n * float(k**3 - k)))
    out = per.groupBy("metric").agg(chi.alias("chi2"))
    out = out.withColumn("p_value", F.coalesce(chi_square_tail(F.col("chi2"), k - 1), F.lit(1.0)))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def pairs(meas: DataFrame, a_family: Column, b_family: Column) -> DataFrame:
    """metric, a, b, subject, va, vb: every treatment of one family against every one of the other, by subject."""
    left = meas.where(a_family).select("metric", "subject", F.col("treatment").alias("a"), F.col("value").alias("va"))
    right = meas.where(b_family).select("metric", "subject", F.col("treatment").alias("b"), F.col("value").alias("vb"))
    return left.join(right, ["metric", "subject"])


def wilcoxon(paired: DataFrame) -> DataFrame:
    """metric, a, b, mean_a, mean_b, diff, w, p_value, effect.

    Zero differences are dropped. Up to 50 without ties or zeros the exact table counts, else the normal
    approximation with tie correction and no continuity correction; no differences: w null, p 1, effect 0. Ranks come
    by ranges of each key's distinct sizes, so one triple with most of the rows is many groups.
    """
    keys = ["metric", "a", "b"]
    d = paired.withColumn("d", F.col("va") - F.col("vb"))
    means = d.groupBy(*keys).agg(F.round(F.avg("va"), 4).alias("mean_a"), F.round(F.avg("vb"), 4).alias("mean_b"), (F.round(F.avg("va") - F.avg("vb"), 4) + F.lit(0.0)).alias("diff"), F.count_if(F.col("d") == 0).alias("zeros"))
    r = placed(d.where("d <> 0").withColumn("size", F.abs("d")), keys, "size", {"ups": F.count_if(F.col("d") > 0)})
    rank = F.col("before") + (F.col("n") + 1) / 2.0  # of all rows of this size
    s = r.groupBy(*keys).agg(
        F.sum(rank * F.col("ups")).alias("up"), F.sum(rank * (F.col("n") - F.col("ups"))).alias("down"),
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).cast("double").alias("t"),
    )
    out = means.join(s, keys, "left").withColumn("w", F.least("up", "down"))
    exact = F.broadcast(signed_rank_table(paired.sparkSession).withColumnsRenamed({"n": "_n", "w": "_w", "p": "_p"}))  # a fixed 22,000 rows
    small = (F.col("n") <= 50) & (F.col("t") == 0) & (F.col("zeros") == 0)
    out = out.join(exact, (F.col("n") == F.col("_n")) & (F.col("w").cast("long") == F.col("_w")) & small, "left")
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4.0) / F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("t")) / 24.0)
    p = F.when(F.col("n").isNull(), 1.0).when(small, F.col("_p")).otherwise(normal_two_sided(z))
    effect = F.coalesce(F.round((F.col("up") - F.col("down")) / (F.col("up") + F.col("down")), 3), F.lit(0.0))
    return out.select(*keys, "mean_a", "mean_b", "diff", "w", p.alias("p_value"), effect.alias("effect"))


def holm(tests: DataFrame, within: tuple[str, ...] = ("metric",), order: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """tests with p_holm, rounded to 4 digits, and significant, tested on the rounded value."""
    by = Window.partitionBy(*within).orderBy("p_value", *order)
    t = tests.withColumn("_adj", F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy(*within)) - F.row_number().over(by) + 1) * F.col("p_value")))
    t = t.withColumn("p_holm", F.round(F.max("_adj").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 4)).drop("_adj")
    return t.withColumn("significant", F.col("p_holm") < 0.05)


def verdicts(tested: DataFrame, lower_better: set[str]) -> DataFrame:
    """tested with verdict: better, worse or none, of a against b."""
    gain = (F.col("mean_a") - F.col("mean_b")) * directions(tested, lower_better)
    return tested.withColumn("verdict", F.when(F.col("p_holm") >= 0.05, "none").when(gain > 0, "better").otherwise("worse"))


def best_per_metric(meas: DataFrame, lower_better: set[str]) -> DataFrame:
    """metric, best, mean; the smaller name on a tie."""
    m = group_means(meas, None).withColumn("order", -directions(meas, lower_better) * F.col("mean"))
    return m.groupBy("metric").agg(F.min_by("treatment", F.struct("order", "treatment")).alias("best"), F.min_by("mean", F.struct("order", "treatment")).alias("mean"))


def ratio_to_best_rival(meas: DataFrame, lower_better: set[str]) -> DataFrame:
    """metric, treatment, ratio: the best other treatment's mean over the own one; null where that is 0."""
    m = group_means(meas, None).withColumn("sign", directions(meas, lower_better))
    by = Window.partitionBy("metric").orderBy(F.col("sign") * F.col("mean"), "treatment")
    others = [by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)]
    # the best of the rest stands right before or at the end of this order
    top = F.greatest(F.max(F.col("sign") * F.col("mean")).over(others[0]), F.max(F.col("sign") * F.col("mean")).over(others[1]))
    return m.select("metric", "treatment", F.try_divide(F.col("sign") * top, F.col("mean")).alias("ratio"))


def two_variants(meas: DataFrame, a: str, b: str, lower_better: set[str]) -> DataFrame:
    """Two treatments side by side: means, direction, p, whether a is better and the difference significant."""
    t = wilcoxon(pairs(meas, F.col("treatment") == a, F.col("treatment") == b))
    sign = directions(t, lower_better)
    return t.select(
        "metric", "mean_a", "mean_b", F.when(sign > 0, "max").otherwise("min").alias("direction"), "p_value",
        ((F.col("mean_a") - F.col("mean_b")) * sign > 0).alias("a_better"), (F.col("p_value") < 0.05).alias("significant"),
    )


def with_footer(wide: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """The rows per subject, then one of averages and one of sample deviations."""
    g = wide.groupingSets([[F.col(subject)], []], F.col(subject)).agg(F.grouping_id().alias("_g"), *[F.avg(c).alias(f"avg_{c}") for c in columns], *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns])
    rows = F.when(F.col("_g") == 0, F.array(F.lit("subject"))).otherwise(F.array(F.lit("average"), F.lit("stdev")))
    pick = [F.when(F.col("kind") == "stdev", F.col(f"sd_{c}")).otherwise(F.col(f"avg_{c}")).alias(c) for c in columns]
    return g.withColumn("kind", F.explode(rows)).select(subject, "kind", *pick)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def matrix(meas: DataFrame, treatments: list[str]) -> DataFrame:
    """metric, subject, and a column per treatment (A3)."""
    return meas.groupBy("metric", "subject").pivot("treatment", treatments).agg(F.first("value"))


def near_best(results: DataFrame, value: str, tolerance: float = 5e-4) -> DataFrame:
    """results with best: within tolerance of the maximum, which comes from one aggregated row."""
    top = results.agg(F.max(value).alias("_top"))
    return results.crossJoin(F.broadcast(top)).withColumn("best", F.abs(F.col(value) - F.col("_top")) < tolerance).drop("_top")
