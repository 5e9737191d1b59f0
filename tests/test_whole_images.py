"""Methods and metrics over whole images against their relational forms; one pass, whatever the number of methods."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fusion, metrics, wavelets, whole

from .test_properties import image, noise, relation

PLAIN = {
    "proposal": lambda px: fusion.weighted_top_hat(px, 25, 0.0703), "classic": lambda px: fusion.classic_top_hat(px, 5, 1.0), "laplacian": fusion.laplacian,
    "ratio": fusion.ratio, "haar": fusion.haar, "db4": wavelets.db4_fusion, "dual_tree": wavelets.dual_tree_fusion,
}


def nodes(df, name):
    return len(re.findall(name, df._jdf.queryExecution().executedPlan().toString()))


def test_seven_methods_are_one_pass(spark):
    px = relation(spark, (noise(31), noise(32)))
    seven = fusion.fan_out(px, {m: fusion.METHODS[m] for m in PLAIN})
    assert nodes(seven, "Window") == 0 and nodes(seven, "staged_") == 0 and nodes(seven, "MapInArrow") == 1
    assert nodes(metrics.evaluate(px.withColumn("f", F.col("vis")), with_vif=False), "Window") == 0


@pytest.mark.parametrize("shape", [(8, 8), (5, 7)])
def test_whole_images_equal_relations(spark, shape):
    px = relation(spark, (noise(33, shape), noise(34, shape)))
    fused = {m: image(fusion.METHODS[m](px), "f", shape) for m in ("proposal", "ratio", "dual_tree")}
    for m, f in fused.items():
        assert np.allclose(f, image(PLAIN[m](px), "f", shape), atol=1e-12), m


def test_images_of_many_sizes_and_batches(spark, monkeypatch):
    sizes = [(8, 8), (1, 1), (3, 5), (8, 8), (2, 9), (1, 1)]
    pairs = [(noise(40 + k, s), noise(60 + k, s)) for k, s in enumerate(sizes)]
    rows = whole.fused(relation(spark, *pairs), {"a": whole.classic_top_hat, "b": lambda v, i: v - i}).orderBy("pair_id", "y", "x").collect()
    want = [(k, y, x, v[y, x], v[y, x] - i[y, x]) for k, (v, i) in enumerate(pairs) for y in range(len(v)) for x in range(len(v[0]))]
    assert [(r["pair_id"], r["y"], r["x"], r["vis"], r["fs"][1]) for r in rows] == want
    import pyarrow as pa

    t = pa.table({c: [w[j] for w in want] for j, c in enumerate(("pair_id", "y", "x", "vis", "f"))})
    for pixels, images, size in ((1, 1, 1), (7, 2, 5), (1000, 2, 3), (10**6, 10, 10**6)):
        monkeypatch.setattr(whole, "PIXELS", pixels)
        monkeypatch.setattr(whole, "IMAGES", images)
        got = [row for rows, (vis, f) in whole._groups(iter(t.to_batches(size)), ["pair_id"], ["vis", "f"]) for row in zip(*rows.to_pydict().values())]
        assert sorted(got) == want


def test_a_gap_is_an_error(spark):
    px = relation(spark, (noise(35), noise(36))).where("NOT (y = 3 AND x = 4)")
    with pytest.raises(Exception, match="must be whole"):
        fusion.METHODS["haar"](px).collect()


def test_vectors_are_dealt_before_they_are_cut_into_pixels(spark, tmp_path):
    import duckdb

    from lumenfold.plans import fixtures

    rows = [(0, [0.1] * 64), (1, [0.2] * 64), (2, [0.3] * 64), (3, [0.1] * 40), (4, [0.1] * 64), (6, [0.1] * 16), (6, [0.2] * 16), (7, [0.3] * 8), (8, [0.1] * 8), (8, [0.2] * 8), (9, [0.2] * 8)]
    rows += [(9, [0.4] * 24), (10, [0.5] * 8), (10, None), (11, []), (13, [0.9, None, -0.9, 0.4] * 2), (12, [None] * 8), (-1, [0.3] * 8), (-2, [0.1] * 8), (14, [0.1] * 8), (14, [0.3] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    px = fixtures.pixels(spark, str(tmp_path))
    plan = px._jdf.queryExecution().executedPlan().toString().split("\n")
    at = {name: [i for i, line in enumerate(plan) if name in line] for name in ("Exchange", "Generate")}
    assert len(at["Exchange"]) == 1 and at["Generate"][0] < at["Exchange"][0]  # rows go up the plan
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = ({tuple(r) for r in x} for x in (px.select("pair_id", "y", "x", "vis", "ir").collect(), c.execute(f"WITH {fixtures.PX} SELECT pair_id, y, x, vis, ir FROM px").fetchall()))
    assert got == want and len(got) > 100
