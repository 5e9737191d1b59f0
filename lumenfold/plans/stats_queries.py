"""Queries of the measurement analytics over the complete blocks of orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import stats
from . import flows
from .fixtures import MANY, MEASURES, many_measures, measures
from .registry import query

NAMES = ["price_mean", "price_sd", "n_orders", "open_rate"]
MANY_NAMES = ["qty", "price", "disc", "tax"]
LOWER = {"price_sd", "open_rate", "disc"}
TREATMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def long(spark, sf_dir):
    return stats.to_long(measures(spark, sf_dir), NAMES)


def many_long(spark, sf_dir):
    return stats.to_long(many_measures(spark, sf_dir), MANY_NAMES)


def long_sql(wide: str, names: list[str]) -> str:
    return f"WITH RECURSIVE {wide}, meas AS (" + " UNION ALL ".join(f"SELECT subject, treatment, '{n}' AS metric, {n} AS value FROM wide" for n in names) + "), dir(metric, sign) AS (VALUES " + ", ".join(f"('{n}', {-1 if n in LOWER else 1})" for n in names) + ")"


M = long_sql(MEASURES, NAMES)
MM = long_sql(MANY, MANY_NAMES)


def rnd(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


@query("a04_unpivot", f"{M} SELECT subject, treatment, metric, {r6('value', 'value')} FROM meas")
def unpivot(spark, sf_dir):
    return rnd(long(spark, sf_dir), "value")


@query("a01_group_means", f"{M} SELECT metric, treatment, round(avg(value), 4) AS mean FROM meas GROUP BY 1, 2")
def group_means(spark, sf_dir):
    return stats.group_means(long(spark, sf_dir))


QUART = "count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max"


@query("a02_describe", f"{M} SELECT metric, treatment, n, {', '.join(r6(c, c) for c in ('mean', 'std', 'min', 'q1', 'median', 'q3', 'max'))} FROM (SELECT metric, treatment, {QUART} FROM meas GROUP BY 1, 2)")
def describe(spark, sf_dir):
    return rnd(stats.describe(long(spark, sf_dir)), "mean", "std", "min", "q1", "median", "q3", "max")


@query("a03_matrix", f"{M} SELECT metric, subject, " + ", ".join(f"""round(max(value) FILTER (treatment = '{t}'), 6) + 0.0 AS t{i}""" for i, t in enumerate(TREATMENTS)) + " FROM meas GROUP BY 1, 2")
def matrix(spark, sf_dir):
    m = stats.matrix(long(spark, sf_dir), TREATMENTS)
    return m.select("metric", "subject", *[rounded(F.col(f"`{t}`")).alias(f"t{i}") for i, t in enumerate(TREATMENTS)])


@query("a05_ranking", f"""{M}, g AS (SELECT metric, treatment, round(avg(value), 4) AS mean FROM meas GROUP BY 1, 2),
r AS (SELECT a.metric, a.treatment, count(*) FILTER (b.mean * sign > a.mean * sign) + (count(*) FILTER (b.mean = a.mean) + 1) / 2.0 AS rank FROM g a JOIN g b USING (metric) JOIN dir USING (metric) GROUP BY 1, 2)
SELECT treatment, round(round(avg(rank), 3), 2) AS avg_rank FROM r GROUP BY 1""")
def ranking(spark, sf_dir):
    return stats.ranking(long(spark, sf_dir), LOWER)


FRIED = """w AS (SELECT a.metric, a.subject, a.treatment, count(*) FILTER (b.value < a.value) + (count(*) FILTER (b.value = a.value) + 1) / CAST(2 AS DOUBLE) AS rank, count(*) FILTER (b.value = a.value) AS ties
  FROM meas a JOIN meas b ON b.metric = a.metric AND b.subject = a.subject GROUP BY 1, 2, 3),
s AS (SELECT metric, treatment, sum(rank) AS r, count(*) AS n, sum(ties * ties - 1) AS t FROM w GROUP BY 1, 2),
f AS (SELECT metric, (12 / (max(n) * CAST(30 AS DOUBLE)) * sum(r * r) - 18 * max(n)) / (1 - sum(t) / (max(n) * CAST(120 AS DOUBLE))) AS chi2 FROM s GROUP BY 1)
SELECT metric, round(chi2, 6) + 0.0 AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) + 0.0 AS p_value, exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 AS significant FROM f"""


@query("a06_friedman", f"{M}, {FRIED}")
def friedman(spark, sf_dir):
    return rnd(stats.friedman(long(spark, sf_dir), 5), "chi2", "p_value")


@query("a06_friedman_many", f"{MM}, {FRIED}")
def friedman_many(spark, sf_dir):
    return rnd(stats.friedman(many_long(spark, sf_dir), 5), "chi2", "p_value")


#: First letters of the family under test; the others are baselines.
FAMILY = ("1-", "2-")
WILCOX = """d AS (SELECT a.metric, a.treatment AS a, b.treatment AS b, a.subject, a.value AS va, b.value AS vb, a.value - b.value AS d FROM meas a JOIN meas b USING (metric, subject)
  WHERE (a.treatment LIKE '1-%' OR a.treatment LIKE '2-%') AND NOT (b.treatment LIKE '1-%' OR b.treatment LIKE '2-%')),
mean AS (SELECT metric, a, b, round(avg(va), 4) AS mean_a, round(avg(vb), 4) AS mean_b, round(avg(va) - avg(vb), 4) + 0.0 AS diff, count(*) FILTER (d = 0) AS zeros FROM d GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY metric, a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, a, b, abs(d)) - 1) / CAST(2 AS DOUBLE) AS rk, count(*) OVER (PARTITION BY metric, a, b, abs(d)) AS ties FROM d WHERE d <> 0),
s AS (SELECT metric, a, b, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down, count(*) AS n, sum(ties * ties - 1) AS t FROM r GROUP BY 1, 2, 3),
dp(n, c) AS (SELECT 0, [CAST(1 AS DOUBLE)] UNION ALL SELECT n + 1, [coalesce(c[i], 0) + CASE WHEN i > n + 1 THEN coalesce(c[i - n - 1], 0) ELSE 0 END FOR i IN range(1, len(c) + n + 2)] FROM dp WHERE n < 50),
z AS (SELECT m.*, least(up, down) AS w, up, down, n, t, least(up, down) - n * (n + 1) / CAST(4 AS DOUBLE) AS dev, sqrt((n * (n + 1) * (2 * n + 1) - t / CAST(2 AS DOUBLE)) / 24) AS se FROM mean m LEFT JOIN s USING (metric, a, b)),
y AS (SELECT *, abs(dev) / se / sqrt(2) AS x FROM z),
e(i, term) AS (SELECT 0, CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, term * 2 / (2 * i + 3) FROM e WHERE i < 150),
p AS (SELECT y.metric, y.a, y.b, mean_a, mean_b, diff, w, CASE WHEN y.n IS NULL THEN 1 WHEN y.n <= 50 AND t = 0 AND zeros = 0 THEN least(1, 2 * list_sum(dp.c[1:CAST(w AS INT) + 1]) / power(2, y.n))
    ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * (SELECT sum(term * power(x, 2 * i + 1)) FROM e) END AS p_value, coalesce(round((up - down) / (up + down), 3), 0) AS effect
  FROM y LEFT JOIN dp ON dp.n = y.n)"""
TEST_COLUMNS = f"metric, a, b, mean_a, mean_b, diff, w, {r6('p_value', 'p_value')}, effect + 0.0 AS effect"
HOLM = """, q AS (SELECT *, count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p_value, a, b) + 1 AS left_over FROM p),
h AS (SELECT *, round(max(least(1, left_over * p_value)) OVER (PARTITION BY metric ORDER BY p_value, a, b ROWS UNBOUNDED PRECEDING), 4) AS p_holm FROM q)"""


def tests(meas):
    mine = F.col("treatment").startswith(FAMILY[0]) | F.col("treatment").startswith(FAMILY[1])
    return stats.wilcoxon(stats.pairs(meas, mine, ~mine))


@query("a07_a08_a10_wilcoxon", f"{M}, {WILCOX} SELECT {TEST_COLUMNS} FROM p")
def wilcoxon(spark, sf_dir):
    return rnd(tests(long(spark, sf_dir)), "p_value", "effect")


@query("a07_wilcoxon_many", f"{MM}, {WILCOX} SELECT {TEST_COLUMNS} FROM p")
def wilcoxon_many(spark, sf_dir):
    return rnd(tests(many_long(spark, sf_dir)), "p_value", "effect")


@query("a09_holm", f"{M}, {WILCOX}{HOLM} SELECT metric, a, b, p_holm, p_holm < 0.05 AS significant FROM h")
def holm(spark, sf_dir):
    return stats.holm(tests(long(spark, sf_dir))).select("metric", "a", "b", "p_holm", "significant")


@query("a13_verdict_tallies", f"""{M}, {WILCOX}{HOLM} SELECT a, CASE WHEN p_holm >= 0.05 THEN 'none' WHEN (mean_a - mean_b) * sign > 0 THEN 'better' ELSE 'worse' END AS verdict, count(*) AS n
FROM h JOIN dir USING (metric) GROUP BY 1, 2""")
def verdict_tallies(spark, sf_dir):
    return stats.verdicts(stats.holm(tests(long(spark, sf_dir))), LOWER).groupBy("a", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("p06_j07_family_pairs", f"{M}, {WILCOX} SELECT metric, a, b, subject, {r6('va', 'va')}, {r6('vb', 'vb')} FROM d")
def family_pairs(spark, sf_dir):
    mine = F.col("treatment").startswith(FAMILY[0]) | F.col("treatment").startswith(FAMILY[1])
    return rnd(stats.pairs(long(spark, sf_dir), mine, ~mine), "va", "vb").select("metric", "a", "b", "subject", "va", "vb")


@query("a11_a15_p12_ablation", f"""{M} SELECT label AS method, metric, round(avg(value), 4) AS mean FROM meas JOIN (VALUES ('1-URGENT', 'urgent'), ('5-LOW', 'low')) l(treatment, label) USING (treatment) GROUP BY 1, 2
UNION ALL SELECT 'all', metric, round(avg(value), 4) FROM meas GROUP BY 2""")
def ablation(spark, sf_dir):
    meas = long(spark, sf_dir)
    labels = spark.createDataFrame([("1-URGENT", "urgent"), ("5-LOW", "low")], "treatment string, method string")
    picked = stats.group_means(meas).join(F.broadcast(labels), "treatment").select("method", "metric", "mean")
    return picked.unionByName(stats.group_means(meas.withColumn("treatment", F.lit("all"))).withColumnRenamed("treatment", "method"))


@query("a12_best_per_metric", f"""{M}, g AS (SELECT metric, treatment, avg(value) AS mean FROM meas GROUP BY 1, 2)
SELECT metric, treatment AS best, {r6("mean", "mean")} FROM g JOIN dir USING (metric) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY sign * mean DESC, treatment) = 1""")
def best(spark, sf_dir):
    return rnd(stats.best_per_metric(long(spark, sf_dir), LOWER), "mean")


@query("a14_two_variants", f"""{M}, {WILCOX.replace("(a.treatment LIKE '1-%' OR a.treatment LIKE '2-%') AND NOT (b.treatment LIKE '1-%' OR b.treatment LIKE '2-%')", "a.treatment = '1-URGENT' AND b.treatment = '5-LOW'")}
SELECT metric, mean_a, mean_b, CASE WHEN sign > 0 THEN 'max' ELSE 'min' END AS direction, {r6("p_value", "p_value")}, (mean_a - mean_b) * sign > 0 AS a_better, p_value < 0.05 AS significant FROM p JOIN dir USING (metric)""")
def two_variants(spark, sf_dir):
    return rnd(stats.two_variants(long(spark, sf_dir), "1-URGENT", "5-LOW", LOWER), "p_value")


@query("a16_footer", f"""WITH {MEASURES}, t AS (SELECT * FROM wide WHERE treatment = '2-HIGH')
SELECT subject, 'subject' AS kind, {r6("price_mean", "price_mean")}, {r6("n_orders", "n_orders")} FROM t UNION ALL SELECT NULL, 'average', {r6("avg(price_mean)", "p")}, {r6("avg(n_orders)", "n")} FROM t
UNION ALL SELECT NULL, 'stdev', {r6("stddev_samp(price_mean)", "p")}, {r6("stddev_samp(n_orders)", "n")} FROM t""")
def footer(spark, sf_dir):
    return rnd(stats.with_footer(measures(spark, sf_dir).where("treatment = '2-HIGH'"), "subject", ["price_mean", "n_orders"]), "price_mean", "n_orders")


@query("a18_a19_a23_display_order", f"""{M}, g AS (SELECT metric, treatment, avg(value) AS mean FROM meas GROUP BY 1, 2), o(treatment, pos) AS (VALUES ('5-LOW', 1), ('1-URGENT', 2), ('3-MEDIUM', 3))
SELECT metric, pos, treatment, {r6("mean", "mean")}, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, treatment) AS bar FROM g JOIN o USING (treatment)""")
def display_order(spark, sf_dir):
    from pyspark.sql import Window

    order = spark.createDataFrame([("5-LOW", 1), ("1-URGENT", 2), ("3-MEDIUM", 3)], "treatment string, pos int")
    g = stats.group_means(long(spark, sf_dir), None).join(F.broadcast(order), "treatment")
    g = g.withColumn("bar", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), "treatment")))
    return rnd(g, "mean").orderBy("metric", "pos")


@query("a20_j05_upsert", f"""{M}, g AS (SELECT metric, treatment, round(avg(value), 4) AS mean FROM meas GROUP BY 1, 2)
SELECT metric, treatment, CASE WHEN treatment = '5-LOW' THEN mean + 1 ELSE mean END AS mean FROM g""")
def upsert(spark, sf_dir):
    old = stats.group_means(long(spark, sf_dir))
    new = old.where("treatment = '5-LOW'").withColumn("mean", F.col("mean") + 1)
    return stats.upsert(old, new, ["metric", "treatment"]).orderBy(F.desc("mean"))


@query("a21_p07_missing_results", f"WITH {MEASURES} SELECT subject, treatment FROM wide WHERE NOT (treatment = '1-URGENT' OR subject % 3 = 0)")
def missing(spark, sf_dir):
    wanted = measures(spark, sf_dir).select("subject", "treatment")
    done = wanted.where("treatment = '1-URGENT' OR subject % 3 = 0")
    return flows.missing_results(wanted, done, ["subject", "treatment"])


@query("a22_box_stats", f"""{M}, q AS (SELECT metric, treatment, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM meas GROUP BY 1, 2)
SELECT metric, treatment, {r6("q1", "q1")}, {r6("median", "median")}, {r6("q3", "q3")}, {r6("min(value)", "low")}, {r6("max(value)", "high")} FROM meas JOIN q USING (metric, treatment)
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY metric, treatment, q1, median, q3""")
def box_stats(spark, sf_dir):
    return rnd(stats.box_stats(long(spark, sf_dir)), "q1", "median", "q3", "low", "high")


@query("a24_distinct", f"WITH {MEASURES} SELECT DISTINCT treatment FROM wide")
def distinct(spark, sf_dir):
    return measures(spark, sf_dir).select("treatment").distinct().orderBy("treatment")


@query("a25_ratio_to_rival", f"""{M}, g AS (SELECT metric, treatment, avg(value) AS mean FROM meas GROUP BY 1, 2)
SELECT a.metric, a.treatment, {r6("max(b.mean * sign) * any_value(sign) / a.mean", "ratio")} FROM g a JOIN g b ON b.metric = a.metric AND b.treatment <> a.treatment JOIN dir ON dir.metric = a.metric GROUP BY a.metric, a.treatment, a.mean""")
def ratio_to_rival(spark, sf_dir):
    return rnd(stats.ratio_to_best_rival(long(spark, sf_dir), LOWER), "ratio")
