"""Numbers over a whole table's order without one task for all rows.

A bounded number of split keys, from a sample taken by a hash, cut the order into ranges. Rows are numbered
within their range by a window, and each range starts where the counts of those before it end. The split
keys depend on the rows alone, so that a lost task gives the same ranges again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

PARTS, SAMPLED = 64, 16


def ranged(df: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """df with _range, of fewer than parts ranges of this order (ascending, nulls first) of about the same size."""
    key = F.struct(*order)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(parts * SAMPLED)  # at most parts * SAMPLED keys
    cuts = sample.withColumn("at", F.ntile(parts).over(Window.orderBy("k"))).groupBy("at").agg(F.min("k").alias("k")).where("at > 1")
    cuts = cuts.agg(F.array_sort(F.collect_set("k")).alias("_cuts"))  # one row of fewer than parts keys
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")


def numbered(df: DataFrame, *order: str, name: str = "rn", parts: int = PARTS) -> DataFrame:
    """df with a row number from 1 in the order of these columns (ascending, nulls first)."""
    out = ranged(df, list(order), parts)
    starts = out.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # at most parts rows
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return out.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + within).cast("int")).drop("_range", "_start")


def placed(df: DataFrame, keys: list[str], value: str, also: dict[str, Column] | None = None, parts: int = PARTS) -> DataFrame:
    """keys, value, n, before, and aggregates (also) for each distinct value of a key: n rows have it, before have a smaller one.

    Equal values are counted together first, so ties never lie on both sides of a border. The distinct values are then
    cut into ranges of (keys, value), summed within each, and begin where the key's earlier ranges end: a key with most of the
    rows is as many groups as it has ranges. The average rank of a value is before + (n + 1) / 2.
    """
    counts = staged(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in (also or {}).items()]), (*keys, value))
    out = ranged(counts, [*keys, value], parts)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))  # a row for each key, and one more for each border within it
    starts = starts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    smaller = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(starts, [*keys, "_range"]).withColumn("before", F.col("_start") + F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    return out.drop("_range", "_start")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """keys and the exact quantiles, linear between neighbours, by picking values at their places; nulls don't count."""
    p = placed(df.where(F.col(value).isNotNull()), keys, value, parts=parts)
    total = p.groupBy(*keys).agg(F.sum("n").alias("_all"))
    p = p.join(total, keys)
    covers = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    found, between = [], []
    for name, share in shares.items():
        at = (F.col("_all") - 1) * share
        found += [F.max(F.when(covers(f(at)), F.col(value))).alias(f"_{name}_{end}") for end, f in (("lo", F.floor), ("hi", F.ceil))]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        between.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return p.groupBy(*keys, "_all").agg(*found).select(*keys, *between)
