import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import tails
from lumenfold.operators import detection, filters, fusion, metrics, morphology, stats, sweep, wavelets
from lumenfold.plans import fixtures, flows
from lumenfold.plans.all_queries import QUERIES
from lumenfold.sources import images, listing, tables

SCHEMA = "pair_id long, y int, x int, vis double, ir double"


def relation(spark, *pairs):
    rows = [(k, y, x, float(v[y, x]), float(i[y, x])) for k, (v, i) in enumerate(pairs) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def image(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", column).collect():
        out[r["y"], r["x"]] = r[column]
    return out


def noise(seed, shape=(8, 8)):
    return np.random.default_rng(seed).random(shape)


def neighbours(shape, offsets, y, x):
    return [(y + a, x + b) for a, b in offsets if 0 <= y + a < shape[0] and 0 <= x + b < shape[1]]


@pytest.mark.parametrize("shape, r", [((8, 8), 2), ((3, 5), 1), ((5, 7), 3)])
def test_disk_opening_equals_brute_force(spark, shape, r):
    v = noise(1, shape)
    rows = morphology.disk_rows(r)
    offsets = [(dy, dx) for dy, h in rows.items() for dx in range(-h, h + 1)]
    scan = lambda f, g: np.array([[g(f[p] for p in neighbours(shape, offsets, y, x)) for x in range(shape[1])] for y in range(shape[0])])
    want = scan(scan(v, min), max)
    got = image(morphology.open_close(relation(spark, (v, v)), ["vis"], "disk", r), "vis_open", shape)
    assert np.allclose(got, want) and (got <= v + 1e-12).all()


def test_single_pixels(spark):
    bright, dark = np.zeros((7, 7)), np.ones((7, 7))
    bright[3, 3], dark[3, 3] = 1, 0
    hats = morphology.top_hats(relation(spark, (bright, dark)), ["vis", "ir"], "disk", 1)
    assert np.allclose(image(hats, "vis_wth", (7, 7)), bright) and np.allclose(image(hats, "ir_bth", (7, 7)), 1 - dark)


def test_closing_covers_and_opening_is_idempotent(spark):
    v = noise(2)
    px = relation(spark, (v, v))
    once = morphology.open_close(px, ["vis"], 45, 2)
    assert (image(once, "vis_close", (8, 8)) >= v - 1e-12).all()
    again = morphology.open_close(once.select("pair_id", "y", "x", F.col("vis_open").alias("vis")), ["vis"], 45, 2)
    assert np.allclose(image(again, "vis_open", (8, 8)), image(once, "vis_open", (8, 8)))


def test_wrong_mode(spark):
    with pytest.raises(ValueError):
        morphology.combined_top_hats(relation(spark, (noise(1), noise(2))), ["vis"], 1, "median")


def test_line_lengths():
    assert [morphology.line_half_length(25, d) for d in morphology.DIRECTIONS] == [25, 18, 25, 18]


def test_no_detail_weight_gives_the_mean(spark):
    v, i = noise(3), noise(4)
    assert np.allclose(image(fusion.weighted_top_hat(relation(spark, (v, i)), 2, 0.0), "f", (8, 8)), (v + i) / 2)


@pytest.mark.parametrize("method", ["laplacian", "haar", "db4"])
def test_equal_sources_are_kept(spark, method):
    v = noise(5, (9, 11)) if method == "laplacian" else noise(5, (8, 10))
    px = relation(spark, (v, v))
    got = {"laplacian": lambda: fusion.laplacian(px, 3), "haar": lambda: fusion.haar(px, 1), "db4": lambda: wavelets.db4_fusion(px, 2)}[method]()
    assert np.allclose(image(got, "f", v.shape), v, atol=1e-9)


def test_odd_sides(spark):
    v = noise(6, (5, 7))
    back = filters.haar_join(filters.haar_split(relation(spark, (v, v)), ["vis"]), ["vis"]).where("y < 5 AND x < 7")
    assert np.allclose(image(back, "vis", (5, 7)), v)


def test_haar_keeps_energy(spark):
    v = noise(7)
    e = filters.haar_split(relation(spark, (v, v)), ["vis"]).agg(F.sum(F.col("vis") * F.col("vis"))).first()[0]
    assert e == pytest.approx((v * v).sum())


def test_metrics_of_equal_and_constant_images(spark):
    v = noise(8, (48, 48))
    same = relation(spark, (v, v)).withColumn("f", F.col("vis"))
    for f in (metrics.ssim, metrics.ssim_fast, metrics.vif, metrics.feature_information):
        assert f(same).first()["value"] == pytest.approx(1.0, abs=1e-6)
    flat = relation(spark, (np.full((8, 8), 0.5), np.full((8, 8), 0.5))).withColumn("f", F.lit(0.5))
    assert metrics.scd(flat).first()["value"] == 0.0
    q = metrics.local_quality(flat).first()
    assert q["q0"] == pytest.approx(1.0) and q["qw"] < 0.05
    assert metrics.entropy(flat, "f").first()["value"] == pytest.approx(0.0, abs=1e-6)


def test_all_sixteen_and_append(spark, tmp_path):
    px = relation(spark, (noise(9, (48, 48)), noise(10, (48, 48))), (noise(7, (48, 48)), noise(8, (48, 48))), (noise(5, (48, 48)), noise(6, (48, 48))))
    bench = flows.Benchmark(spark, f"file://{tmp_path}/b", batch_pairs=1)
    methods = {"average": fusion.average, "haar": lambda px: fusion.haar(px, 2)}

    def broken(px):
        raise RuntimeError("no such method\nmore")

    first = bench.run(px.where("pair_id < 2"), {**methods, "broken": broken}, with_vif=False).collect()
    assert len(first) == 4 and {tuple(r) for r in bench.failures().collect()} == {("no such method", 2, "broken")}
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("b/fused/*/*/*.parquet")}
    assert len(files) == 4
    out = {(r["method"], r["pair_id"]): r for r in bench.run(px, {**methods, "broken": fusion.average}).collect()}
    assert set(out) == {(m, p) for m in ("average", "haar", "broken") for p in range(3)}
    assert set(out["haar", 0].asDict()) == {"method", "pair_id", *flows.RECORD} and all(v is not None for v in out["haar", 2])
    assert out["haar", 0]["VIF"] is None and [out[r["method"], r["pair_id"]] for r in first] == first
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # what was there is not written again
    assert bench.failures().count() == 0
    whole = {p: p.stat().st_mtime_ns for p in tmp_path.glob("b/*/*/*/*.parquet")}
    assert {(r["method"], r["pair_id"]): r for r in bench.run(px, {**methods, "broken": fusion.average}).collect()} == out
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("b/*/*/*/*.parquet")} == whole


def test_a_lost_partition_is_done_again(spark, tmp_path):
    px = relation(spark, (noise(9), noise(10)), (noise(7), noise(8)))
    bench = flows.Benchmark(spark, f"file://{tmp_path}/b", batch_pairs=1)
    want = sorted(map(tuple, bench.run(px, {"average": fusion.average}, with_vif=False).collect()), key=str)
    for table, batch in (("fused", 0), ("results", 0), ("results", 1)):  # as a run leaves it that is ended halfway
        for p in tmp_path.glob(f"b/{table}/method=average/batch={batch}/*"):
            p.unlink()
    assert sorted(map(tuple, bench.run(px, {"average": fusion.average}, with_vif=False).collect()), key=str) == want


def test_signed_rank_without_differences_and_ties(spark):
    rows = [("m", s, t, 1.0) for s in range(5) for t in ("a", "b")]
    meas = spark.createDataFrame(rows, "metric string, subject int, treatment string, value double")
    r = stats.wilcoxon(stats.pairs(meas, F.col("treatment") == "a", F.col("treatment") == "b")).first()
    assert (r["w"], r["p_value"], r["effect"]) == (None, 1.0, 0.0)


def test_statistics_without_spread(spark):
    rows = [(m, s, t, 0.0 if m == "flat" else float(s + (t == "b"))) for m in ("flat", "other") for s in range(6) for t in "abc"]
    meas = spark.createDataFrame(rows, "metric string, subject int, treatment string, value double")
    got = {r["metric"]: r for r in stats.friedman(meas, 3).collect()}
    assert (got["flat"]["p_value"], got["flat"]["significant"]) == (1.0, False) and got["other"]["p_value"] < 0.05
    ratios = {(r["metric"], r["treatment"]): r["ratio"] for r in stats.ratio_to_best_rival(meas, set()).collect()}
    assert ratios["flat", "a"] is None and ratios["other", "a"] == pytest.approx(3.5 / 2.5)


def test_boxes_without_area_and_size(spark):
    b = spark.createDataFrame([(1, 0, 1, 0.5, 0.5, 0.0, 0.0)], "image_id long, class_id int, gt_no int, cx double, cy double, w double, h double")
    pred = b.select(F.lit("m").alias("method"), "image_id", "class_id", F.col("gt_no").alias("pred_no"), "cx", "cy", "w", "h", F.lit(0.9).alias("conf"))
    assert [r["iou"] for r in detection.candidate_matches(b, pred, 0.0).collect()] == [0.0]
    xml = "<annotation><size><width>0</width><height>0</height></size><object><name>Car</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>512</xmax><ymax>384</ymax></bndbox></object></annotation>"
    rows = spark.createDataFrame([(1, xml)], "image_id long, xml string")
    assert [tuple(r) for r in detection.to_boxes(detection.parse_annotations(rows), ("People", "Car")).collect()] == [(1, 1, 0.25, 0.25, 0.5, 0.5)]
    assert detection.manifest(b, ("People", "Car")).first().asDict() == {"nc": 2, "names": ["People", "Car"], "seen": 1}


def reflected(v, p, off):
    n = len(v)
    period = max(1, 2 * (n - 1) + 2 * off)
    p %= period
    return v[min(p, period - off - p)]


@pytest.mark.parametrize("border, off", [("mirror", 0), ("symmetric", 1)])
def test_filters_on_images_smaller_than_their_taps(spark, border, off):
    v = noise(21, (3, 5))
    taps = filters.gaussian_taps(11, 1.5)
    along = lambda line: [sum(w * reflected(line, i + d, off) for d, w in taps.items()) for i in range(len(line))]
    want = np.apply_along_axis(along, 0, np.apply_along_axis(along, 1, v))
    assert np.allclose(image(filters.separable(relation(spark, (v, v)), ["vis"], taps, border), "vis", v.shape), want)


def test_small_images_and_missing_pixels(spark):
    v = noise(22, (3, 5))
    assert np.allclose(image(wavelets.db4_fusion(relation(spark, (v, v)), 2), "f", v.shape), v, atol=1e-9)
    assert np.allclose(image(wavelets.dual_tree_fusion(relation(spark, (v, v)), 1), "f", v.shape), v, atol=1e-9)
    row = spark.createDataFrame([(0, 0, x, float(x * x), 0.0) for x in (0, 1, 2, 4, 5)], SCHEMA)
    got = {r["x"]: r["vis_gx"] for r in filters.central_gradient(row, ["vis"]).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 4: 9.0, 5: 9.0}  # one-sided beside the gap
    with pytest.raises(Exception, match="whole lines"):
        filters.separable(row, ["vis"], filters.PYRAMID_TAPS).collect()
    with pytest.raises(Exception, match="without missing"):
        morphology.line_filter(row, {"lo": ("min", "vis")}, 5, 0).collect()


@pytest.mark.parametrize("k", [4, 7, 8, 25])
def test_lines_by_doubling_equal_frames(spark, k):
    v = noise(23, (6, 31))
    px = relation(spark, (v, v))
    for direction in morphology.DIRECTIONS:
        wanted = {"lo": ("min", "vis"), "hi": ("max", "vis")}
        wide = morphology.line_filter(px, wanted, k, direction)
        w = morphology._line_window(("pair_id",), direction).rangeBetween(-k, k)
        plain = px.withColumns({"lo": F.min("vis").over(w), "hi": F.max("vis").over(w)})
        for c in wanted:
            assert np.array_equal(image(wide, c, v.shape), image(plain, c, v.shape))


def test_records_equal_the_single_metrics(spark):
    px = relation(spark, (noise(24, (48, 48)), noise(25, (48, 48)))).withColumn("f", F.greatest("vis", "ir"))
    got = metrics.evaluate(px).first()
    single = {
        "EN": metrics.entropy(px, "f"), "SD": metrics.std_dev(px), "FE": metrics.fusion_efficiency(px), "MG": metrics.mean_gradient(px), "MI_ir": metrics.mutual_information(px, "f", "ir"),
        "SF": metrics.spatial_frequency(px), "SSIM": metrics.ssim(px), "SCD": metrics.scd(px), "VIF": metrics.vif(px), "FMI": metrics.feature_information(px),
    }
    for name, df in single.items():
        assert got[name] == pytest.approx(df.first()["value"], abs=1e-9), name
    fast = metrics.fast_pass(px).first()
    assert fast["ssim"] == pytest.approx(metrics.ssim_fast(px).first()["value"]) and fast["psnr"] == pytest.approx(metrics.psnr_share(px).first()["value"])
    assert fast["en"] == pytest.approx(metrics.entropy(px, "f", floor=0.0).first()["value"]) and fast["nabf"] == pytest.approx(metrics.edge_quality(px, True).first()["nabf"])


def test_numbers_over_an_order(spark):
    from lumenfold.operators.ordering import numbered

    keys = [None, *range(3000), 5, 5, *range(10_000, 10_200)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(7)
    got = [r["k"] for r in numbered(rows, "k", "i", parts=8).orderBy("rn").collect()]
    assert got == sorted(keys, key=lambda k: -1 if k is None else k)
    assert sorted(r["rn"] for r in numbered(rows, "k", "i").collect()) == list(range(1, len(keys) + 1))
    assert numbered(rows.limit(0), "k").count() == 0


def test_discovery_takes_whole_folder_names(spark):
    files = spark.createDataFrame([("x/stair/a.png",), ("x/IR/b.png",), ("y/IR/a.png",), ("ir/c.png",)], "path string")
    got = {r["stem"]: (r["path"], r["rank"]) for r in listing.discover(files, ["ir"]).collect()}
    assert got == {"a": ("y/IR/a.png", 0), "b": ("x/IR/b.png", 0), "c": ("ir/c.png", 0)}


def test_far_tails_keep_their_digits(spark):
    import math

    df = spark.createDataFrame([(x,) for x in (1.9, 2.1, 6.0, 9.0, 20.0)], "x double")
    for r in df.select("x", tails.normal_two_sided(F.col("x")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["x"] / math.sqrt(2)), rel=1e-9)


def test_a_resumed_sweep_equals_a_whole_one(spark, tmp_path):
    px = relation(spark, (noise(11), noise(12)))
    kept = lambda name: sweep.Generations(spark, f"file://{tmp_path}/{name}")
    configs = spark.createDataFrame([(2, 1), (2, 2)], "n int, rounds int")
    bounds = dict(sweep.BOUNDS)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    try:
        sweep.BOUNDS["r"] = (1.0, 2.0)
        fitness = sweep.SourceStore(px).fitness("information", classic=True)
        whole = rows(sweep.run(configs, fitness, 2, kept("a")))
        sweep.run(configs, fitness, 1, kept("b"))
        assert rows(sweep.run(configs, fitness, 2, kept("b"))) == whole and len(whole) == 4
        # ended while the last generation was written: files without the marker
        for p in (tmp_path / "b/state/t=2").iterdir():
            if p.name == "_SUCCESS" or p.suffix == ".parquet":
                p.unlink()
        assert kept("b").last()[1] == 1
        assert rows(sweep.run(configs, fitness, 2, kept("b"))) == whole
    finally:
        sweep.BOUNDS.update(bounds)
    history = kept("b").history()
    assert rows(history) == rows(kept("a").history()) and history.count() == 2 * 1 + 2 * 2
    best = {r["config"]: r["fit"] for r in sweep.best_configuration(history).collect()}
    assert best == {r[0]: pytest.approx(r[STATE_TOP]) for r in whole}


STATE_TOP = sweep.STATE.index("top_fit")


def test_the_store_measures_what_the_plain_form_does(spark):
    px = relation(spark, (noise(13), noise(14)), (noise(15, (9, 7)), noise(16, (9, 7))))
    c = spark.createDataFrame([(f"c{i}", 1 + i % 2, 0.05 + 0.03 * i) for i in range(37)], "candidate string, r int, m double")
    store = sweep.SourceStore(px)
    for classic in (False, True):
        plain = {r["candidate"]: r for r in sweep.both_fitnesses(sweep.fused_candidates(px, c, [1, 2], classic)).collect()}
        got = store.fitnesses(c, classic).collect()
        assert len(got) == len(plain) == 37
        for r in got:
            assert (r["edges"], r["information"]) == pytest.approx((plain[r["candidate"]]["edges"], plain[r["candidate"]]["information"]), abs=1e-9)
    plan = store.of_radius(1).groupBy("pair_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tails(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.0, 1.96, 4.5, 9.0)], "x double")
    import math

    for r in df.select("x", tails.normal_two_sided(F.col("x")).alias("p"), *[tails.chi_square_tail(F.col("x"), k).alias(f"c{k}") for k in (1, 2, 3)]).collect():
        assert r["p"] == pytest.approx(math.erfc(r["x"] / math.sqrt(2)), abs=1e-12)
        assert r["c1"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), abs=1e-12)
        assert r["c2"] == pytest.approx(math.exp(-r["x"] / 2), abs=1e-12)


def test_malformed_annotations_and_blank_labels(spark):
    rows = spark.createDataFrame([(1, "<annotation><object>"), (2, "no xml"), (3, None)], "image_id long, xml string")
    assert detection.to_boxes(detection.parse_annotations(rows), ("People",)).count() == 0
    labels = spark.createDataFrame([(1, ""), (2, "\n \n0 0.5 0.5 0.1 0.1\n")], "image_id long, label string")
    assert [tuple(r) for r in detection.parse_labels(labels).collect()] == [(2, 0, 0.5, 0.5, 0.1, 0.1)]


def png(path, rows):
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source_and_listing(spark, tmp_path):
    for folder in ("vis", "ir"):
        (tmp_path / folder).mkdir()
    rows = [[0, 50, 100, 255], [1, 2, 3, 4], [9, 8, 7, 200]]
    png(tmp_path / "vis/a.png", rows)
    png(tmp_path / "ir/a.PNG", rows)
    (tmp_path / "vis/broken.png").write_bytes(b"no image")
    px = images.to_pixels(images.scan(spark, f"file://{tmp_path}/vis"))
    assert np.allclose(image(px, "v", (3, 4)), np.array(rows) / 255)
    pairs = listing.list_pairs(listing.scan(spark, f"file://{tmp_path}/vis"), listing.scan(spark, f"file://{tmp_path}/ir")).collect()
    assert [r["stem"] for r in pairs] == ["a"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 0.12345678)], "method string, value double")
    tables.write_csv(df, f"file://{tmp_path}/t")
    assert tables.read_csv(spark, f"file://{tmp_path}/t", "method string, value double").first() == ("a, b", 0.123457)


def test_degenerate_pairs_are_marked(spark):
    listing_rows = spark.createDataFrame([("d/VIS_IR_scene.png",), ("d/VIS_tree.png",), ("d/tree_IR.png",)], "path string")
    got = {r["core"]: r["degenerate"] for r in listing.reorganise(listing_rows).collect()}
    assert got == {"scene": True, "tree": False}


def test_swarms_improve(spark, tmp_path):
    px = relation(spark, (noise(11), noise(12)))

    configs = spark.createDataFrame([(2, 2)], "n int, rounds int")
    bounds = dict(sweep.BOUNDS)
    try:
        sweep.BOUNDS["r"] = (1.0, 2.0)
        out = sweep.run(configs, sweep.SourceStore(px).fitness("information", classic=True), 2, sweep.Generations(spark, f"file://{tmp_path}/g")).collect()
    finally:
        sweep.BOUNDS.update(bounds)
    assert len(out) == 2 and all(r["top_fit"] >= r["best_fit"] for r in out)


def test_detection_queries_reach_every_row(spark):
    folder = "/root/testdata/sf0.001"
    assert QUERIES["s10_s11_label_round_trip"](spark, folder).count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_fitness_curve_takes_every_pair_and_three_objectives(spark):
    folder, m = "/root/testdata/sf0.001", 0.3
    held = spark.createDataFrame([("x", 3, m)], "candidate string, r int, m double")
    px = fixtures.pixels(spark, folder)
    got = QUERIES["o06_fitness_curve"](spark, folder).where(F.col("m") == m).first()
    for name, fitness, classic in (("edges", sweep.fitness_edges, False), ("information", sweep.fitness_information, False), ("classic", sweep.fitness_information, True)):
        assert got[name] == pytest.approx(fitness(sweep.fused_candidates(px, held, [3], classic)).first()["fitness"], abs=1e-9)
