"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the source's target over its size.

The whole part of the rate is taken at once; the fractions are settled in pairs: mass (in words) moves
at random from one document of a pair to the other until one of the two fractions is 0 or 1, so
expectations hold and each pair's words stay the same. This is done in two tiers.

Large documents, those above their source's median and above 1 / ``BUCKET`` of its words (so fewer than
``BUCKET`` of a source), are folded first, the largest first, to one unsettled residual per source. It alone
is rounded by itself (column ``alone``), by its fraction; where that would leave what the others can't make up
(less than nothing, or more than ``cap`` times their words), the other way. What is then left of the target,
which differs from the others' own share by less than that one document, sets the others' rate.

The others are dealt by a hash into buckets of about ``BUCKET`` rows, each folded to one unsettled residual;
the residuals are dealt and folded again, level by level, until each source has one. Only that last one changes
the source's number of words, by less than its own size: at most the source's median, or 1 / ``BUCKET`` of it.
DataFrame functions only.

Nulls: a null text has size 0, a null source is a source of its own (the last), null ids are kept.
Empty table: empty result. Repeated rows are counted as one key with a number and told apart by
that number, so a row that repeats often takes no longer path. A very long text counts by its words alone:
one that is most of its source is settled with the large ones, and the others make up for it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

BUCKET = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per source: sid (place in code-point order, null last), source_size, n, target, cut (documents above it are large).

    Where targets stop at cap times the size and the rest is shared again by weight until none is
    above, each target is least(cap * size, level * weight) for one level. In order of
    cap * size / weight, the capped sources come first, so the level follows from running sums.
    One row per source, so these windows hold the table of sources, not of documents.
    """
    sizes = units.groupBy("source", "size").agg(F.sum("rows").alias("rows"))  # so that a median holds a source's distinct sizes only
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"), F.percentile("size", 0.5, F.col("rows")).alias("median")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / share)
    per = per.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "sid", "level")))
    level = F.min("fits").over(every)["level"]  # of the first source, in that order, which isn't capped
    return per.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select(
        "source", "sid", F.col("source_size").cast("long").alias("source_size"), "n", "target", F.greatest("median", F.col("source_size") / BUCKET).alias("cut")
    )


def _uniform(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


def _fold(items: Column, seed: int) -> Column:
    """Sequential pivotal rounding of items (key, w, x, at): the residual's item and the places of those settled at 1."""
    eps = 1e-9
    start = F.struct(
        F.lit(-1).alias("at"), F.lit(0).cast("long").alias("key"), F.lit(1.0).alias("w"), F.lit(0.0).alias("x"),
        F.array().cast("array<int>").alias("ones"),
    )

    def merge(s: Column, e: Column) -> Column:
        up = F.least((1 - s["x"]) * s["w"], e["x"] * e["w"])
        down = F.least(s["x"] * s["w"], (1 - e["x"]) * e["w"])
        more = F.when(_uniform(e["key"], s["key"], F.lit(seed)) * (up + down) < down, up).otherwise(-down)
        return F.struct(s.alias("s"), e.alias("e"), (s["x"] + more / s["w"]).alias("a"), (e["x"] - more / e["w"]).alias("b"))

    def settle(m: Column) -> Column:
        s, e, a, b = m["s"], m["e"], m["a"], m["b"]
        a_ends = (a <= eps) | (a >= 1 - eps)
        one = F.when(a_ends, F.when(a > 0.5, s["at"])).otherwise(F.when(b > 0.5, e["at"]))
        ones = F.when(one >= 0, F.concat(s["ones"], F.array(one))).otherwise(s["ones"])
        pick = lambda f, x: F.when(a_ends, e[f]).otherwise(s[f]) if x is None else F.when(a_ends, b).otherwise(a)
        return F.struct(
            pick("at", None).alias("at"), pick("key", None).alias("key"), pick("w", None).alias("w"),
            pick("", 1).alias("x"), ones.alias("ones"),
        )

    # the middle step is bound to a one-element array, so that its random draw is made once
    return F.aggregate(items, start, lambda s, e: F.element_at(F.transform(F.array(merge(s, e)), settle), 1))


def _grouped(rows: DataFrame, seed: int) -> DataFrame:
    """rows (sid, bucket, key, w, x, ...) folded by (sid, bucket): items, ones, residual."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("less"), "key", "w", "x", "size", "id", "copy")))
    g = rows.groupBy("sid", "bucket").agg(items.alias("items"))
    at = F.transform("items", lambda e, i: F.struct(e["key"].alias("key"), e["w"].alias("w"), e["x"].alias("x"), i.alias("at")))
    return g.withColumn("done", _fold(F.filter(at, lambda e: (e["x"] > 0) & (e["w"] > 0)), seed))


def _whole(rate: Column) -> Column:
    return F.floor(rate + 1e-9).cast("long")


def _dealt(rows: DataFrame, bucket: Column) -> DataFrame:
    """rows (sid, rate, key, id, size, copy) with bucket, words w and the fraction x of the rate."""
    fraction = F.col("rate") - _whole(F.col("rate"))
    return rows.select(
        "sid", bucket.alias("bucket"), "key", "id", "size", "copy", F.col("size").cast("double").alias("w"),
        F.when(F.abs(fraction) < 1e-9, 0.0).otherwise(fraction).alias("x"),
    )


def _large_residual(level: DataFrame, targets: DataFrame, cap: float, seed: int) -> DataFrame:
    """Per source of level: items, done, fate (of the residual), and left and words, the target and words of all other documents."""
    size = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda n, e: n + e["size"])
    chosen = F.transform("done.ones", lambda i: F.element_at("items", i + 1))
    t = level.join(targets.select("sid", "target", "source_size", "rate"), "sid").withColumns({
        "left": F.col("target") - _whole(F.col("rate")) * size(F.col("items")) - size(chosen),
        "words": (F.col("source_size") - size(F.col("items"))).cast("double"),
    })
    off = lambda w: F.abs(F.col("left") - w - F.least(F.greatest(F.col("left") - w, F.lit(0.0)), float(cap) * F.col("words")))
    without, taken = off(F.lit(0.0)), off(F.col("done.w"))
    draw = _uniform("done.key", F.lit(seed + 98)) < F.col("done.x")
    fate = F.when(F.col("done.at") < 0, False).when(without < taken - 1e-6, False).when(taken < without - 1e-6, True).otherwise(draw)
    t = t.withColumn("fate", fate)
    return t.select("sid", "items", "done", "fate", (F.col("left") - F.when(F.col("fate"), F.col("done.w")).otherwise(0.0)).alias("left"), "words")


def _settled(level: DataFrame) -> DataFrame:
    """level (sid, items, done, fate) by item: sid, item, one (its fraction became 1), open (it is the residual)."""
    t = level.select("sid", F.posexplode("items").alias("at", "item"), F.col("done.at").alias("last"), "done.ones", "fate")
    is_open = F.col("at") == F.col("last")
    one = F.when(is_open, F.coalesce("fate", F.lit(False))).otherwise(F.array_contains("ones", F.col("at")))
    return t.select("sid", "item", one.alias("one"), is_open.alias("open"))


def mix_sources(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7,
) -> DataFrame:
    """One row per row of docs: id, source, size, copy (number among equal rows), source_size, target, copies, alone, taken."""
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    units = written(units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = written(source_targets(units, weights, cap).withColumn("rate", rate))
    rows = units.join(targets.select("source", "sid", "n", "rate", "cut"), units["source"].eqNullSafe(targets["source"])).select(
        "sid", "n", "rate", (F.col("size") > F.col("cut")).alias("is_large"), "id", "size",
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"),
    )
    rows = rows.withColumn("key", F.xxhash64("id", "size", "copy", F.lit(seed)))
    large = _grouped(_dealt(rows.where("is_large"), F.lit(0).cast("long")), seed)  # fewer than BUCKET of a source
    large = written(_large_residual(large, targets, cap, seed))
    rates = targets.select("sid", "target", "source_size").join(large.select("sid", "left", "words"), "sid", "left")
    left, words = F.coalesce("left", "target"), F.coalesce("words", "source_size")
    rate = F.when(words > 0, F.least(F.greatest(left / words, F.lit(0.0)), F.lit(float(cap)))).otherwise(0.0)
    rates = written(rates.select("sid", rate.alias("rate")))
    rows = _dealt(rows.where(~F.col("is_large")).drop("rate").join(rates, "sid"), F.pmod("key", F.ceil(F.col("n") / BUCKET).cast("long")))
    level = written(_grouped(rows, seed))
    first, levels = level, []
    most = targets.agg(F.max("n")).first()[0] or 0
    while most > BUCKET:  # about log(rows) / log(BUCKET) levels
        most = -(-most // BUCKET)
        up = level.where("done.at >= 0").select(
            "sid", F.floor(F.col("bucket") / BUCKET).cast("long").alias("bucket"), F.col("done.key").alias("key"),
            F.col("done.w").alias("w"), F.col("done.x").alias("x"), F.lit(None).cast("long").alias("size"),
            F.col("bucket").alias("id"), F.lit(None).cast("long").alias("copy"),
        )
        level = written(_grouped(up, seed + len(levels) + 1))
        levels.append(level)
    for upper in reversed([first, *levels]):  # the fate of each level's residuals, from the top down
        if upper is level:
            known = upper.select("sid", "bucket", (_uniform("done.key", F.lit(seed + 99)) < F.col("done.x")).alias("fate"))
        else:
            known = fates
        settled = _settled(upper.join(known, ["sid", "bucket"], "left"))
        fates = settled.select("sid", F.col("item.id").alias("bucket"), F.col("one").alias("fate")) if upper is not first else settled
    few = fates.join(rates, "sid").withColumn("alone", F.lit(False))
    many = _settled(large).withColumnRenamed("open", "alone").join(targets.select("sid", "rate"), "sid")
    out = few.drop("open").unionByName(many).join(targets.drop("rate"), "sid")
    copies = _whole(F.col("rate")) + F.col("one").cast("long")
    return out.select(
        "source", F.col("item.id").alias("id"), F.col("item.size").alias("size"), F.col("item.copy").alias("copy"),
        "source_size", "target", copies.alias("copies"), "alone", (copies * F.col("item.size")).alias("taken"),
    )
