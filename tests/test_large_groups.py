"""What keeps one large image, key or folder from being one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import filters, fusion, morphology, ordering, stats, tiles
from lumenfold.sources import listing

from .test_properties import image, noise, relation


@pytest.mark.parametrize("shape, size", [((40, 33), 16), ((16, 48), 8), ((5, 7), 16)])
def test_tiles_equal_whole_images(spark, shape, size):
    v, i = noise(51, shape), noise(52, shape)
    px = relation(spark, (v, i))
    whole = image(fusion.weighted_top_hat(px, 3, 0.3), "f", shape)
    assert np.allclose(image(fusion.weighted_top_hat(px, 3, 0.3, tile=size), "f", shape), whole)
    blur = lambda df, keys: filters.separable(df, ["vis"], filters.gaussian_taps(7, 1.5), "mirror", keys)
    if min(shape) > 3:
        assert np.allclose(image(tiles.tiled(px, blur, size, 3), "vis", shape), image(blur(px, ("pair_id",)), "vis", shape))
    lines = lambda df, keys: morphology.line_filter(df, {"lo": ("min", "vis")}, 5, 45, keys)
    assert np.allclose(image(tiles.tiled(px, lines, size, 5), "lo", shape), image(lines(px, ("pair_id",)), "lo", shape))


def test_an_image_is_many_tasks(spark):
    px = spark.range(256 * 256).select(F.lit(0).cast("long").alias("pair_id"), F.floor(F.col("id") / 256).cast("int").alias("y"), (F.col("id") % 256).cast("int").alias("x"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("vis"))
    px = px.withColumn("ir", 1 - F.col("vis"))
    part = tiles.with_halo(px, 64, 10)
    assert part.select("_ty", "_tx").where("_ty < 4 AND _tx < 4").distinct().count() == 16
    assert part.count() < 1.9 * 256 * 256
    with pytest.raises(ValueError):
        tiles.with_halo(px, 4, 5)
    differ = fusion.weighted_top_hat(px, 5, 0.3, tile=64).join(fusion.weighted_top_hat(px, 5, 0.3).withColumnRenamed("f", "g"), ["pair_id", "y", "x"]).where("abs(f - g) > 1e-12 OR f IS NULL")
    assert differ.count() == 0


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_places_and_quantiles_of_one_large_key(spark, parts):
    rng = np.random.default_rng(5)
    values = {"big": rng.integers(0, 400, 5000) / 8, "ties": np.ones(300), "one": np.array([2.5]), "many": rng.random(700)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("big", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r["k"], r["v"]): (r["before"], r["n"]) for r in ordering.placed(df.where("v IS NOT NULL"), ["k"], "v", parts=parts).collect()}
    assert got == {(k, v): (int((vs < v).sum()), int((vs == v).sum())) for k, vs in values.items() for v in map(float, np.unique(vs))}
    shares = {"a": 0.0, "q": 0.25, "m": 0.5, "t": 0.9, "z": 1.0}
    for r in ordering.quantiles(df, ["k"], "v", shares, parts).collect():
        assert [r[n] for n in shares] == pytest.approx([np.quantile(values[r["k"]], s) for s in shares.values()])
    assert ordering.placed(df.limit(0), ["k"], "v").count() == ordering.quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_signed_ranks_of_one_large_triple(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 50, 4000) / 4, rng.integers(0, 50, 4000) / 4
    rows = spark.createDataFrame([("m", "a", "b", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "metric string, a string, b string, subject long, va double, vb double")
    d = a - b
    d = d[d != 0]
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    r = stats.wilcoxon(rows).first()
    assert r["w"] == min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert r["effect"] == pytest.approx(round((ranks[d > 0].sum() - ranks[d < 0].sum()) / ranks.sum(), 3))


def test_names_that_contain_a_part(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abAB_1é"), n))
    names = [(int(rng.integers(3)), word(int(rng.integers(0, 9)))) for _ in range(400)]
    parts = [(int(rng.integers(3)), word(int(rng.integers(0, 7)))) for _ in range(120)] + [(0, ""), (1, "é"), (2, "ab")]
    got = listing.containing(spark.createDataFrame(parts, "d int, p string"), spark.createDataFrame(names, "d int, n string"), ["d"], "p", "n").collect()
    want = [(d, p, n) for d, p in parts for e, n in names if d == e and p in n]
    assert sorted((r["d"], r["p"], r["n"]) for r in got) == sorted(want)


def test_a_folder_of_many_names(spark):
    names = spark.range(20_000).select(F.lit("f").alias("d"), F.format_string("scene_%06d_IR.png", "id").alias("n"))
    parts = spark.range(20_000).select(F.lit("f").alias("d"), F.format_string("scene_%06d", "id").alias("p"))
    assert listing.containing(parts, names, ["d"], "p", "n").count() == 20_000


def test_runs_of_names_are_not_broadcast(spark, tmp_path):
    """Small files hold many times their size in runs; a core is one expression, not one for each condition."""
    spark.range(300).select(F.format_string("d/VIS_scene_%04d.png", "id").alias("path")).union(spark.range(300).select(F.format_string("d/scene_%04d_IR.png", "id").alias("path"))).write.parquet(f"{tmp_path}/names")
    found = listing.reorganise(spark.read.parquet(f"{tmp_path}/names"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and plan.count("regexp") < 400
    assert found.count() == 300
    assert {r["core"] for r in listing.reorganise(spark.createDataFrame([("d/VIS_IR_a_IR_VIS.png",), ("d/IR_VIS_b_VIS_IR.png",), ("d/a_IR.png",), ("d/VIS_b_VIS_IR.png",)], "path string")).collect()} == {"a", "VIS_b_VIS", "b_VIS"}


def test_boxes_are_dealt_once(spark, monkeypatch):
    """Between the two tables of boxes and of ranked predictions no row is shuffled; each task writes its part of a bucket."""
    from lumenfold.operators import detection
    from lumenfold.sources import staging

    box = "image_id long, class_id int, box_id long, cx double, cy double, w double, h double"
    gt = spark.createDataFrame([(1, 0, 1, 0.5, 0.5, 0.2, 0.2), (1, 0, 2, 0.1, 0.1, 0.1, 0.1), (1, None, 3, 0.5, 0.5, 0.2, 0.2), (2, 1, 4, 0.3, 0.3, 0.2, 0.2), (None, 1, 5, 0.3, 0.3, 0.2, 0.2)], box)
    pred = spark.createDataFrame([("a", 1, 0, 1, 0.5, 0.5, 0.2, 0.2, 0.9), ("a", 1, 0, 2, 0.5, 0.5, 0.2, 0.19, 0.8), ("a", 1, None, 3, 0.5, 0.5, 0.2, 0.2, 0.7), ("a", 2, 1, 4, 0.9, 0.9, 0.1, 0.1, 0.6), ("a", None, 1, 5, 0.3, 0.3, 0.2, 0.2, 0.5)], f"method string, {box}, conf double")
    plans = []
    monkeypatch.setattr(detection, "staged", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staging.staged(df, *a, **k))
    got = {r["class_id"]: (r["n_gt"], r["tp"], r["fp"]) for r in detection.average_precision(gt, pred).collect()}
    assert got == {0: (2, 1, 1), 1: (2, 0, 2)}
    assert "Exchange" not in plans[0] and "Exchange" not in plans[1] and len(plans) == 3
