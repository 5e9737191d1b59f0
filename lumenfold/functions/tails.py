"""Tail probabilities as plain columns: the series run inside Spark's own array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = 120


def erfc(x: Column) -> Column:
    """1 - erf of x >= 0: by the series up to 2, by a continued fraction beyond, where the difference would cancel."""
    below = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: (k / 2.0) / (x + t))
    return F.when(x < 2.0, 1.0 - erf(x)).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / (x + below))


def erf(x: Column) -> Column:
    """erf of x >= 0 by exp(-x^2) times a series of positive terms; 1 from 6 on."""
    step = F.lit(2.0) * x * x
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS)), F.struct(x.alias("t"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct((a["t"] * step / (2.0 * k + 3.0)).alias("t"), (a["s"] + a["t"]).alias("s")),
    )["s"]
    return F.when(x >= 6.0, 1.0).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * series)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi_square_tail(x: Column, df: int) -> Column:
    """P(X > x) for df degrees of freedom: a finite sum, with erfc for odd ones."""
    y = x / 2.0
    half = df / 2.0
    start = 1.0 if df % 2 == 0 else 0.5
    total = F.exp(-y) if df % 2 == 0 else erfc(F.sqrt(y))
    a = start
    while a < half - 1e-9:
        total = total + F.pow(y, F.lit(a)) * F.exp(-y) / math.gamma(a + 1.0)
        a += 1.0
    return total


def signed_rank_table(spark: SparkSession, most: int = 50) -> DataFrame:
    """(n, w, p): two-sided exact p of the signed-rank statistic, n up to most; about 22,000 rows for 50."""
    rows, counts = [], [1]
    for n in range(1, most + 1):
        longer = counts + [0] * n
        for s, c in enumerate(counts):
            longer[s + n] += c
        counts, below = longer, 0
        for w in range(n * (n + 1) // 4 + 1):
            below += counts[w]
            rows.append((n, w, min(1.0, 2.0 * below / 2.0**n)))
    return spark.createDataFrame(rows, "n long, w long, p double")
