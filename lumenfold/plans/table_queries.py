"""Queries of the listings, detection tables and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import detection, filters, stats, sweep
from ..sources import listing, tables
from ..sources.staging import new_path, staged
from .fixtures import FILES, GT, MEASURES, NAMES, PRED, PSO, PX, annotations, files, measures, pixels, predictions, raster, sweep_history, table, truth
from .pixel_queries import MCOLS, hist_sql, mirrored, r6, sobel_sql, stencil_sql, taps_sql
from .registry import query

# --- listings
STEM = "regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1)"
EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
IMAGES = f"img AS (SELECT folder, path, {STEM} AS stem FROM files WHERE {EXT} IN ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff'))"


def folder(spark, sf_dir, name):
    return files(spark, sf_dir).where(F.col("folder") == name)


@query("s03_j01_p05_pair_listing", f"WITH {FILES}, {IMAGES} SELECT v.stem, min(v.path) AS vis_path, min(i.path) AS ir_path FROM img v JOIN img i ON v.stem = i.stem WHERE v.folder = 'VIS' AND i.folder = 'IR' GROUP BY 1")
def pair_listing(spark, sf_dir):
    return listing.list_pairs(folder(spark, sf_dir, "VIS"), folder(spark, sf_dir, "IR"))


for _name, _required in (("j03_labelled_pairs", True), ("j04_optional_labels", False)):

    @query(_name, f"""WITH {FILES}, {IMAGES}, v AS (SELECT * FROM img WHERE folder = 'VIS'), i AS (SELECT * FROM img WHERE folder = 'IR'), l AS (SELECT {STEM} AS stem, min(path) AS label_path FROM files WHERE folder = 'LABEL' GROUP BY 1)
SELECT v.stem, v.path AS vis_path, i.path AS ir_path, label_path FROM v JOIN i ON i.stem = v.stem {"JOIN" if _required else "LEFT JOIN"} l ON l.stem = v.stem""")
    def labelled(spark, sf_dir, required=_required):
        f = files(spark, sf_dir)
        return listing.list_labelled(*[f.where(F.col("folder") == n) for n in ("VIS", "IR", "LABEL")], required)


@query("s04_discovery", f"WITH {FILES}, {IMAGES} SELECT stem, coalesce(min(path) FILTER (folder = 'IR'), min(path)) AS path, CASE WHEN bool_or(folder = 'IR') THEN 0 ELSE 2 END AS rank FROM img GROUP BY 1")
def discovery(spark, sf_dir):
    return listing.discover(files(spark, sf_dir), ["ir", "thermal"])


@query("s05_d05_split_listing", f"WITH {FILES} SELECT path, CASE WHEN length(path) % 3 = 0 THEN 'train' WHEN length(path) % 3 = 1 THEN 'val' END AS split FROM files WHERE length(path) % 3 < 2")
def split_listing(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("plain", F.col("path"))
    kind = F.element_at(F.array(F.lit("/train/"), F.lit("/test/"), F.lit("/other/")), F.length("path") % 3 + 1)
    f = listing.with_split(f.withColumn("path", F.concat(F.lit("set"), kind, F.col("path"))))
    return f.withColumn("split", detection.rename_split(F.col("split"))).where("split IS NOT NULL").select(F.col("plain").alias("path"), "split")


@query("s13_batch_sizes", f"WITH {PX}, n AS (SELECT count(DISTINCT pair_id) AS n FROM px) SELECT b.range AS batch, least(4, n - 4 * b.range) AS pairs FROM n, range(100000) b WHERE 4 * b.range < n")
def batch_sizes(spark, sf_dir):
    ids = pixels(spark, sf_dir).select("pair_id").distinct()
    return listing.batches(ids, 4, 11).groupBy("batch").agg(F.count(F.lit(1)).alias("pairs"))


@query("s14_j02_reorganise", f"""WITH {FILES}, d AS (SELECT 'd' || (k % 50) AS directory, stem, k FROM stems)
SELECT v.directory, v.stem AS core, v.directory || '/VIS_' || v.stem || '.png' AS vis_path, min(i.directory || '/' || i.stem || '_IR.png') AS ir_path, false AS degenerate
FROM d v JOIN d i ON v.directory = i.directory AND contains(i.stem || '_IR.png', v.stem) WHERE i.k % 10 <> 3 AND NOT contains(upper(v.stem), 'IR') AND NOT contains(upper(i.stem), 'VIS') AND NOT contains(upper(v.stem), 'VIS') GROUP BY 1, 2, 3""")
def reorganise(spark, sf_dir):
    v = folder(spark, sf_dir, "VIS").withColumn("stem", listing.stem(F.col("path")))
    v = v.where(~F.upper("stem").contains("VIS") & ~F.upper("stem").contains("IR"))
    k = F.regexp_extract("stem", r"_(\d+)\z", 1).cast("long")
    d = F.concat(F.lit("d"), (k % 50).cast("string"), F.lit("/"))
    rows = F.array_compact(F.array(F.concat(d, F.lit("VIS_"), "stem", F.lit(".png")), F.when(k % 10 != 3, F.concat(d, "stem", F.lit("_IR.png")))))
    return listing.reorganise(v.select(F.explode(rows).alias("path")))


# --- detection
@query("s09_d01_boxes", f"""WITH {GT}, i AS (SELECT *, floor((cx - w / 2) * 1024) AS x0, floor((cy - h / 2) * 768) AS y0, floor((cx + w / 2) * 1024) AS x1, floor((cy + h / 2) * 768) AS y1 FROM gt)
SELECT image_id, class_id, round((x0 + x1) / 2 / 1024, 6) AS cx, round((y0 + y1) / 2 / 768, 6) AS cy, round((x1 - x0) / 1024, 6) AS w, round((y1 - y0) / 768, 6) AS h FROM i WHERE class_id < 5""")
def boxes(spark, sf_dir):
    return detection.to_boxes(detection.parse_annotations(annotations(spark, sf_dir)), NAMES)


@query("d02_single_class_boxes", f"""WITH {GT}, i AS (SELECT *, floor((cx - w / 2) * 1024) AS x0, floor((cx + w / 2) * 1024) AS x1 FROM gt)
SELECT image_id, 0 AS class_id, count(*) AS n, round(sum(round((x1 - x0) / 1024, 6)), 6) + 0.0 AS w FROM i GROUP BY image_id""")
def single_class_boxes(spark, sf_dir):
    b = detection.to_boxes(detection.parse_annotations(annotations(spark, sf_dir)), None)
    return b.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("w")).alias("w"))


LINE = "printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)"


@query("s10_s11_label_round_trip", f"WITH {GT} SELECT image_id, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM gt")
def label_round_trip(spark, sf_dir):
    return detection.parse_labels(detection.format_labels(truth(spark, sf_dir)))


@query("s11_manifest", f"WITH {GT} SELECT 6 AS nc, 'People,Car,Bus,Motorcycle,Lamp,Other' AS names, count(DISTINCT class_id) AS seen FROM gt")
def manifest(spark, sf_dir):
    m = detection.manifest(truth(spark, sf_dir), (*NAMES, "Other"))
    return m.select("nc", F.array_join("names", ",").alias("names"), "seen")


IDS = f"WITH {GT}, n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM gt))"


@query("d03_head_split", f"{IDS} SELECT image_id, CASE WHEN rn <= 40 THEN 'train' ELSE 'val' END AS split FROM n WHERE rn <= 60")
def head_split(spark, sf_dir):
    return detection.head_split(truth(spark, sf_dir).select("image_id").distinct(), 40, 20)


@query("d04_share_split", f"{IDS} SELECT image_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM n WHERE rn > floor(n * 0.8) OR rn <= 100")
def share_split(spark, sf_dir):
    return detection.share_split(truth(spark, sf_dir).select("image_id").distinct(), 0.8, {"train": 100})


@query("d06_mixed_modality", f"WITH {GT} SELECT image_id || '__' || m AS image, class_id, count(*) AS n FROM gt CROSS JOIN (VALUES ('vi'), ('ir')) t(m) GROUP BY 1, 2")
def mixed(spark, sf_dir):
    return detection.mixed_modality(truth(spark, sf_dir)).groupBy("image", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("d07_label_fan_out", f"WITH {GT} SELECT method, image_id, count(*) AS n FROM gt CROSS JOIN (VALUES ('VIS'), ('IR'), ('FUSED')) t(method) GROUP BY 1, 2")
def label_fan_out(spark, sf_dir):
    return detection.fan_out_labels(truth(spark, sf_dir), ["VIS", "IR", "FUSED"]).groupBy("method", "image_id").agg(F.count(F.lit(1)).alias("n"))


@query("p11_d08_class_counts", f"WITH {GT}, {PRED} SELECT image_id, method, count(*) FILTER (conf >= 0.3 AND class_id = 0) AS people, count(*) FILTER (conf >= 0.3 AND class_id = 4) AS lamps FROM pred GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    return detection.class_counts(predictions(spark, sf_dir), {"people": 0, "lamps": 4})


@query("p10_candidate_scenes", f"WITH {GT} SELECT image_id FROM gt GROUP BY 1 HAVING count(*) FILTER (class_id = 0) >= 1 AND count(*) FILTER (class_id = 4) >= 2")
def candidate_scenes(spark, sf_dir):
    return detection.candidate_scenes(truth(spark, sf_dir), {0: 1, 4: 2})


@query("d11_pick_scenes", f"""WITH {GT}, {PRED}, s AS (SELECT image_id, count(*) FILTER (class_id = 0) AS people, count(*) FILTER (class_id = 4) AS lamps FROM pred WHERE conf >= 0.3 GROUP BY 1),
a AS (SELECT image_id FROM s ORDER BY people DESC, image_id LIMIT 1) SELECT a.image_id AS first_image, (SELECT image_id FROM s WHERE s.image_id <> a.image_id ORDER BY lamps DESC, image_id LIMIT 1) AS second_image FROM a""")
def pick_scenes(spark, sf_dir):
    p = predictions(spark, sf_dir).where("conf >= 0.3").groupBy("image_id").agg(F.count_if(F.col("class_id") == 0).alias("people"), F.count_if(F.col("class_id") == 4).alias("lamps"))
    return detection.pick_scenes(p, "people", "lamps")


NUMBERED = """g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY class_id, box_id, cx, cy, w, h) AS gt_no FROM gt), p AS (SELECT *, row_number() OVER (PARTITION BY method, image_id ORDER BY conf DESC, class_id, box_id, cx, cy, w, h) AS pred_no FROM pred),
c0 AS (SELECT p.method, p.image_id, p.class_id, pred_no, gt_no, conf, greatest(least(p.cx + p.w / 2, g.cx + g.w / 2) - greatest(p.cx - p.w / 2, g.cx - g.w / 2), 0) * greatest(least(p.cy + p.h / 2, g.cy + g.h / 2) - greatest(p.cy - p.h / 2, g.cy - g.h / 2), 0) AS inter, p.w * p.h AS pa, g.w * g.h AS ga
  FROM p JOIN g ON g.image_id = p.image_id AND g.class_id = p.class_id), c AS (SELECT *, inter / (pa + ga - inter) AS iou FROM c0 WHERE inter / (pa + ga - inter) >= 0.5)"""


@query("j09_box_matching", f"WITH {GT}, {PRED}, {NUMBERED} SELECT method, image_id, class_id, pred_no, gt_no, {r6('iou', 'iou')} FROM c")
def box_matching(spark, sf_dir):
    g = detection.numbered(truth(spark, sf_dir), "gt_no", *detection.GT_ORDER)
    p = detection.numbered(predictions(spark, sf_dir), "pred_no", F.desc("conf"), *detection.GT_ORDER)
    return detection.candidate_matches(g, p).select("method", "image_id", "class_id", "pred_no", "gt_no", rounded(F.col("iou")).alias("iou"))


#: Greedy matching in SQL: one candidate at a time, in order, within each image and class.
GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY method, image_id, class_id ORDER BY conf DESC, pred_no, iou DESC, gt_no) AS rn FROM c),
m(method, image_id, class_id, rn, ps, gs) AS (SELECT method, image_id, class_id, rn, [pred_no], [gt_no] FROM o WHERE rn = 1
  UNION ALL SELECT o.method, o.image_id, o.class_id, o.rn, CASE WHEN list_contains(ps, pred_no) OR list_contains(gs, gt_no) THEN ps ELSE list_append(ps, pred_no) END,
    CASE WHEN list_contains(ps, pred_no) OR list_contains(gs, gt_no) THEN gs ELSE list_append(gs, gt_no) END FROM m JOIN o ON o.method = m.method AND o.image_id = m.image_id AND o.class_id = m.class_id AND o.rn = m.rn + 1),
hit AS (SELECT method, image_id, class_id, unnest(ps) AS pred_no FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY method, image_id, class_id ORDER BY rn DESC) = 1)),
s AS (SELECT p.*, CASE WHEN hit.pred_no IS NULL THEN 0 ELSE 1 END AS hit, (SELECT count(*) FROM gt WHERE gt.class_id = p.class_id) AS n_gt FROM p LEFT JOIN hit ON hit.method = p.method AND hit.image_id = p.image_id AND hit.class_id = p.class_id AND hit.pred_no = p.pred_no),
q AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS pos FROM s WINDOW w AS (PARTITION BY method, class_id ORDER BY conf DESC, image_id, pred_no)),
ap AS (SELECT method, class_id, avg(coalesce(best, 0)) AS ap, any_value(n_gt) AS n_gt, any_value(tp) AS tp, any_value(fp) AS fp FROM (
  SELECT t.method, t.class_id, r.range, t.n_gt, t.tp, t.fp, (SELECT max(tp / CAST(pos AS DOUBLE)) FROM q WHERE q.method = t.method AND q.class_id = t.class_id AND floor(q.tp / CAST(q.n_gt AS DOUBLE) * 100 + 1e-9) >= r.range) AS best
  FROM (SELECT method, class_id, max(n_gt) AS n_gt, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(1 - hit) AS BIGINT) AS fp FROM s GROUP BY 1, 2) t, range(101) r) GROUP BY 1, 2)"""
SCORED = f"WITH RECURSIVE {GT}, {PRED}, {NUMBERED}, {GREEDY}"


@query("d09_average_precision", f"{SCORED} SELECT method, class_id, {r6('ap', 'ap')}, n_gt, tp, fp FROM ap")
def average_precision(spark, sf_dir):
    return detection.average_precision(truth(spark, sf_dir), predictions(spark, sf_dir)).withColumn("ap", rounded(F.col("ap")))


@query("d09_scores", f"{SCORED} SELECT method, {r6('avg(ap)', 'map50')}, {r6('sum(tp) / sum(tp + fp)', 'precision')}, {r6('sum(tp) / sum(n_gt)', 'recall')} FROM ap GROUP BY 1")
def scores(spark, sf_dir):
    return detection.scores(truth(spark, sf_dir), predictions(spark, sf_dir)).select("method", *[rounded(F.col(c)).alias(c) for c in ("map50", "precision", "recall")])


#: The same at ten overlaps: a detector at an overlap counts as a detector of its own.
TEN = "th(th) AS (SELECT round(CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * range, 2) FROM range(10)), c10 AS (SELECT c.* REPLACE (method || '|' || th AS method) FROM c JOIN th ON iou >= th), p10 AS (SELECT p.* REPLACE (method || '|' || th AS method) FROM p, th)"
GREEDY_TEN = GREEDY.replace(" FROM c),", " FROM c10),").replace("FROM p LEFT JOIN hit", "FROM p10 p LEFT JOIN hit")


@query("d09_map50_95", f"WITH RECURSIVE {GT}, {PRED}, {NUMBERED}, {TEN}, {GREEDY_TEN} SELECT split_part(method, '|', 1) AS method, {r6('avg(ap)', 'map50_95')} FROM ap GROUP BY 1")
def map50_95(spark, sf_dir):
    """Mean over ten overlaps and the classes, all overlaps in one pass."""
    return detection.mean_ap(truth(spark, sf_dir), predictions(spark, sf_dir)).withColumn("map50_95", rounded(F.col("map50_95")))


@query("d10_wide_ap", f"{SCORED} SELECT method, " + ", ".join(f"round(max(ap) FILTER (class_id = {i}), 6) + 0.0 AS AP50_{n}" for i, n in enumerate(NAMES)) + " FROM ap GROUP BY 1")
def wide_ap(spark, sf_dir):
    names = dict(enumerate(NAMES))
    w = detection.wide_ap(detection.average_precision(truth(spark, sf_dir), predictions(spark, sf_dir)).where("class_id < 5"), names)
    return w.select("method", *[rounded(F.col(f"AP50_{n}")).alias(f"AP50_{n}") for n in NAMES])


@query("d12_complementary_mean", f"""{SCORED}, mm AS (SELECT method, avg(ap) AS mean FROM ap WHERE class_id IN (0, 4) GROUP BY 1), b AS (SELECT max(mean) AS best FROM mm WHERE method IN ('VIS', 'IR'))
SELECT method, {r6("mean", "mean")}, {r6("best", "best_single")}, mean > best AS beats_single FROM mm, b""")
def complementary(spark, sf_dir):
    c = detection.complementary_mean(detection.average_precision(truth(spark, sf_dir), predictions(spark, sf_dir)), (0, 4), ("VIS", "IR"))
    return c.withColumns({k: rounded(F.col(k)) for k in ("mean", "best_single")})


# --- sweeps
@query("o09_convergence", f"WITH {PSO} SELECT config, CAST(iter AS INT) AS iter, {r6('max(fit) OVER (PARTITION BY config ORDER BY iter)', 'best')} FROM pso")
def convergence(spark, sf_dir):
    return sweep.convergence(sweep_history(spark, sf_dir)).withColumn("best", rounded(F.col("best")))


@query("o07_best_configuration", f"WITH {PSO} SELECT config, CAST(iter AS INT) AS iter, {r6('r', 'r')}, {r6('m', 'm')}, {r6('fit', 'fit')} FROM pso QUALIFY row_number() OVER (PARTITION BY config ORDER BY fit DESC, iter) = 1")
def best_configuration(spark, sf_dir):
    return sweep.best_configuration(sweep_history(spark, sf_dir)).select("config", "iter", *[rounded(F.col(c)).alias(c) for c in ("r", "m", "fit")])


@query("o08_resume", f"WITH {PSO}, l AS (SELECT config, CAST(max(iter) AS INT) AS last FROM pso GROUP BY 1) SELECT config, last, 41 * (SELECT count(*) FROM pso) // 1000 - last AS left FROM l WHERE last < 41 * (SELECT count(*) FROM pso) // 1000")
def resume(spark, sf_dir):
    h = sweep_history(spark, sf_dir)
    return sweep.to_resume(h, int(41 * h.count() // 1000)).select("config", "last", F.col("left").cast("long").alias("left"))


@query("s12_state", f"WITH {PSO} SELECT config, CAST(max(iter) AS INT) AS t, count(*) AS entries, {r6('max(fit)', 'best')} FROM pso GROUP BY 1")
def state(spark, sf_dir):
    h = sweep_history(spark, sf_dir).select("config", F.col("iter").alias("it"), F.col("fit").alias("gbest_fit"), "r", "m")
    texts = tables.state_as_json(h)
    back = texts.select("config", F.from_json("state", "t int, history array<struct<it:int,gbest_fit:double,r:double,m:double>>").alias("s"))
    best = F.array_max(F.transform("s.history", lambda x: x["gbest_fit"]))
    return back.select("config", "s.t", F.size("s.history").cast("long").alias("entries"), rounded(best).alias("best"))


@query("s12_state_round_trip", f"WITH {PSO} SELECT CAST(config AS VARCHAR) AS config, CAST(max(iter) OVER w AS INT) AS t, CAST(count(*) OVER w AS INT) AS evals, max(iter) OVER w >= 30 AS done, CAST(iter AS INT) AS it, {r6('fit', 'gbest_fit')}, {r6('r', 'r')}, {r6('m', 'm')} FROM pso WINDOW w AS (PARTITION BY config)")
def state_round_trip(spark, sf_dir):
    """Sweep state written to the shared folder and read back."""
    path = new_path(spark, "state")
    tables.write_state(sweep_history(spark, sf_dir).select("config", F.col("iter").alias("it"), F.col("fit").alias("gbest_fit"), "r", "m"), path, 30)
    back = tables.read_state(spark, path, lines=True)
    return back.select("config", "t", "evals", "done", "it", *[rounded(F.col(c)).alias(c) for c in ("gbest_fit", "r", "m")])


@query("s06_s07_csv_round_trip", f"WITH {MEASURES} SELECT subject, treatment, {r6('price_mean', 'price_mean')}, {r6('price_sd', 'price_sd')}, {r6('n_orders', 'n_orders')}, {r6('open_rate', 'open_rate')} FROM wide")
def csv_round_trip(spark, sf_dir):
    """A result table written with six digits to the shared folder and read back by its schema."""
    m, path = measures(spark, sf_dir), new_path(spark, "results")
    tables.write_csv(m, path)
    return tables.read_csv(spark, path, m.schema)


@query("a17_near_best", f"WITH {PSO} SELECT config, CAST(iter AS INT) AS iter, {r6('fit', 'fit')} FROM pso WHERE abs((SELECT max(fit) FROM pso) - fit) < 5")
def near_best(spark, sf_dir):
    return stats.near_best(sweep_history(spark, sf_dir), "fit", 5.0).where("best").select("config", "iter", rounded(F.col("fit")).alias("fit"))


@query("o04_o05_swarm_step", f"""WITH {PSO}, s AS (SELECT *, count(*) OVER (PARTITION BY config) AS n FROM pso), b AS (SELECT *, first_value(r) OVER w AS top_r, first_value(m) OVER w AS top_m FROM s WINDOW w AS (PARTITION BY config ORDER BY fit DESC, particle)),
v AS (SELECT *, 0.7 * 0.1 + 1.5 * 0.25 * (r - r) + 1.5 * 0.5 * (top_r - r) AS vr, 0.7 * -0.1 + 1.5 * 0.75 * (m - m) + 1.5 * 0.125 * (top_m - m) AS vm FROM b)
SELECT config, particle, {r6("least(greatest(r + vr, 1), 25)", "r")}, {r6("least(greatest(m + vm, 0.05), 1.2)", "m")}, {r6("vr", "vr")}, {r6("vm", "vm")} FROM v""")
def swarm_step(spark, sf_dir):
    h = sweep_history(spark, sf_dir)
    fixed = {"vr": 0.1, "vm": -0.1, "u1r": 0.25, "u1m": 0.75, "u2r": 0.5, "u2m": 0.125}
    s = h.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"n": F.lit(1), "rounds": F.lit(6)} | {c: F.lit(None).cast("double") for c in ("best_fit", "best_r", "best_m")})
    out = sweep.step(s, F.lit(2))
    return out.select("config", "particle", *[rounded(F.col(c)).alias(c) for c in ("r", "m", "vr", "vm")])


#: The configurations of the sweep query: swarm sizes (published) and rounds (a fifth of the published ones).
SWARMS, ROUNDS = (2, 4, 6, 8, 10), (2, 4, 6, 8, 10)


def arithmetic(salt: int) -> sweep.Draw:
    """Draws that SQL can make too."""
    return lambda more: ((F.col("n") * 7919 + F.col("rounds") * 104729 + F.col("particle") * 1299709 + (salt + more) * 15485863) % 99991) / 99991.0


def _draw(salt: str) -> str:
    return f"((n * 7919 + rounds * 104729 + particle * 1299709 + ({salt}) * CAST(15485863 AS BIGINT)) % 99991) / CAST(99991 AS DOUBLE)"


FITNESS = "-((r0 - a) * (r0 - a) + va) / 100 - 4 * ((m - b) * (m - b) + vb)"


@query("o04_o05_o08_sweep", f"""WITH RECURSIVE mo AS (SELECT avg(1 + CAST(event_id % 25 AS DOUBLE)) AS a, var_pop(1 + CAST(event_id % 25 AS DOUBLE)) AS va, avg((event_id * 7 % 116) / CAST(100 AS DOUBLE)) AS b, var_pop((event_id * 7 % 116) / CAST(100 AS DOUBLE)) AS vb FROM events),
p0 AS (SELECT CAST(n AS BIGINT) AS n, CAST(rounds AS BIGINT) AS rounds, p.range AS particle FROM (VALUES {", ".join(f"({n})" for n in SWARMS)}) s(n), (VALUES {", ".join(f"({t})" for t in ROUNDS)}) c(rounds), range(10) p WHERE p.range < n),
st AS (
  SELECT 0 AS t, n, rounds, particle, 1 + 24 * {_draw("1000")} AS r, CAST(0.05 AS DOUBLE) + CAST(1.15 AS DOUBLE) * {_draw("1001")} AS m, CAST(-0.3 AS DOUBLE) + CAST(0.6 AS DOUBLE) * {_draw("1002")} AS vr, CAST(-0.3 AS DOUBLE) + CAST(0.6 AS DOUBLE) * {_draw("1003")} AS vm,
    CAST(NULL AS DOUBLE) AS best_fit, CAST(NULL AS DOUBLE) AS best_r, CAST(NULL AS DOUBLE) AS best_m, CAST(NULL AS DOUBLE) AS top_fit, CAST(NULL AS DOUBLE) AS top_r, CAST(NULL AS DOUBLE) AS top_m FROM p0
  UNION ALL
  SELECT t + 1, n, rounds, particle, least(greatest(r + nvr, 1), 25), least(greatest(m + nvm, 0.05), CAST(1.2 AS DOUBLE)), nvr, nvm, bf, br, bm, tf, tr, tm FROM (
    SELECT *, w * vr + 1.5 * {_draw("7000 + 10 * t")} * (br - r) + 1.5 * {_draw("7002 + 10 * t")} * (tr - r) AS nvr, w * vm + 1.5 * {_draw("7001 + 10 * t")} * (bm - m) + 1.5 * {_draw("7003 + 10 * t")} * (tm - m) AS nvm FROM (
      SELECT *, CAST(0.9 AS DOUBLE) - CAST(0.5 AS DOUBLE) * t / greatest(1, rounds - 1) AS w, first_value(bf) OVER o AS tf, first_value(br) OVER o AS tr, first_value(bm) OVER o AS tm FROM (
        SELECT *, CASE WHEN best_fit IS NULL OR fit > best_fit THEN fit ELSE best_fit END AS bf, CASE WHEN best_fit IS NULL OR fit > best_fit THEN r ELSE best_r END AS br, CASE WHEN best_fit IS NULL OR fit > best_fit THEN m ELSE best_m END AS bm FROM (
          SELECT *, {FITNESS} AS fit FROM (SELECT *, round_even(r, 0) AS r0 FROM st WHERE t < rounds), mo)
      ) WINDOW o AS (PARTITION BY n, rounds ORDER BY bf DESC, particle)))
)
SELECT n || 'x' || rounds AS config, CAST(particle AS INT) AS particle, {", ".join(r6(c, c) for c in ("r", "m", "vr", "vm", "best_fit", "best_r", "best_m", "top_fit", "top_r", "top_m"))} FROM st WHERE t = rounds""")
def whole_sweep(spark, sf_dir):
    """All 25 configurations over a fitness with its peak at moments of the events; ended after three generations and gone on with from the kept state."""
    r, m = 1.0 + (F.col("event_id") % 25).cast("double"), (F.col("event_id") * 7 % 116) / 100.0
    moments = staged(table(spark, sf_dir, "events").agg(F.avg(r).alias("a"), F.var_pop(r).alias("va"), F.avg(m).alias("b"), F.var_pop(m).alias("vb")), ("a",))

    def fitness(candidates):
        return candidates.crossJoin(F.broadcast(moments)).select("candidate", F.expr(FITNESS.replace("r0", "r")).alias("fitness"))  # one row of moments

    configs = sweep.configurations(list(SWARMS), list(ROUNDS), spark)
    folder = new_path(spark, "sweep")
    sweep.run(configs, fitness, 3, sweep.Generations(spark, folder), draws=arithmetic)
    end = sweep.run(configs, fitness, max(ROUNDS), sweep.Generations(spark, folder), draws=arithmetic)
    return end.select("config", "particle", *[rounded(F.col(c)).alias(c) for c in sweep.STATE[4:]])


#: Candidates of the fitness queries: (candidate, r, m); r is rounded and both held to their bounds.
CANDIDATES = [("a", 1.4, 0.01), ("b", 2.0, 0.07), ("c", 2.4, 0.3)]


def candidate_rows(spark):
    return spark.createDataFrame(CANDIDATES, "candidate string, r double, m double")


#: The classic operator's disks of radius 1 and 2, by neighbour joins; then every candidate's image.
DISKS = "o(r, dy, dx) AS (VALUES " + ", ".join(f"({r}, {dy}, {dx})" for r in (1, 2) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= int((r * r - dy * dy) ** 0.5 + 0.5)) + ")"
CLASSIC = f"""WITH {PX}, {DISKS}, pt AS (SELECT pair_id, y, x, 'vis' AS c, vis AS v FROM px UNION ALL SELECT pair_id, y, x, 'ir', ir FROM px),
lo AS (SELECT a.pair_id, a.y, a.x, a.c, o.r, min(b.v) AS lo, max(b.v) AS hi FROM pt a CROSS JOIN o JOIN pt b ON b.pair_id = a.pair_id AND b.c = a.c AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
oc AS (SELECT a.pair_id, a.y, a.x, a.c, a.r, max(b.lo) AS op, min(b.hi) AS cl FROM lo a JOIN o ON o.r = a.r JOIN lo b ON b.r = a.r AND b.pair_id = a.pair_id AND b.c = a.c AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
hat AS (SELECT pair_id, y, x, r, max(v - op) AS w, max(cl - v) AS b FROM oc JOIN pt USING (pair_id, y, x, c) GROUP BY ALL),
cand(candidate, r, m) AS (VALUES ('a', 1, CAST(0.05 AS DOUBLE)), ('b', 2, CAST(0.07 AS DOUBLE)), ('c', 2, CAST(0.3 AS DOUBLE))),
fx AS (SELECT candidate || ':' || pair_id AS pair_id, y, x, vis, ir, least(greatest((vis + ir) / 2 + m * w - m * b, 0.0), 1.0) AS f FROM px JOIN hat USING (pair_id, y, x) JOIN cand USING (r)),
mo AS (SELECT pair_id, y, x, f, vis, ir, f * f AS ff, vis * vis AS vv, ir * ir AS ii, f * vis AS fv, f * ir AS fi FROM fx), {taps_sql(filters.gaussian_taps(11, 1.5))}, {stencil_sql("mo", MCOLS, 7, "mirror", "s")}"""
_one = lambda m, mm, fm: f"((2 * f * {m} + 0.0001) * (2 * ({fm} - f * {m}) + 0.0009)) / ((f * f + {m} * {m} + 0.0001) * ((ff - f * f) + ({mm} - {m} * {m}) + 0.0009) + 1e-12)"
SSIM = f"si AS (SELECT pair_id, (avg({_one('vis', 'vv', 'fv')}) + avg({_one('ir', 'ii', 'fi')})) / 2 AS ssim FROM s GROUP BY 1)"


@query("o02_fitness_information", f"""{CLASSIC}, {SSIM}, {hist_sql("f", "h")}, en AS (SELECT pair_id, -sum(p * log2(p)) / 8 AS en FROM h GROUP BY 1),
ps AS (SELECT pair_id, log10(1 / greatest((avg(power(f - vis, 2)) + avg(power(f - ir, 2))) / 2, 1e-12)) / 10 AS psnr FROM fx GROUP BY 1)
SELECT split_part(pair_id, ':', 1) AS candidate, {r6("avg(ssim + en + psnr)", "fitness")} FROM si JOIN en USING (pair_id) JOIN ps USING (pair_id) GROUP BY 1""")
def fitness_information(spark, sf_dir):
    held = sweep.clipped(candidate_rows(spark))
    return sweep.SourceStore(pixels(spark, sf_dir)).fitness("information", classic=True)(held).withColumn("fitness", rounded(F.col("fitness")))


_q = lambda s: f"""0.9994 / (1 + exp(-15.0 * (CASE WHEN {s}.g > sf.g THEN sf.g / ({s}.g + 1e-12) WHEN {s}.g < sf.g THEN {s}.g / (sf.g + 1e-12) ELSE sf.g END - 0.5))) * 0.9879 / (1 + exp(-22.0 * (1 - abs({s}.a - sf.a) / (pi() / 2) - 0.8)))"""


@query("o01_o03_fitness_edges", f"""{CLASSIC}, {SSIM.replace("si AS", "ss AS")}, {sobel_sql("fx", "vis", "mirror", "sv")}, {sobel_sql("fx", "ir", "mirror", "si")}, {sobel_sql("fx", "f", "mirror", "sf")},
z AS (SELECT pair_id, sv.g AS gv, si.g AS gi, sf.g AS gf, {_q("sv")} AS qv, {_q("si")} AS qi FROM sv JOIN si USING (pair_id, y, x) JOIN sf USING (pair_id, y, x)),
qe AS (SELECT pair_id, sum(qv * gv + qi * gi) / (sum(gv + gi) + 1e-12) AS qabf, sum(CASE WHEN gf > gv AND gf > gi THEN (1 - qv) * gv + (1 - qi) * gi ELSE 0 END) / (sum(gv + gi) + 1e-12) AS nabf FROM z GROUP BY 1),
w AS (SELECT pair_id, f - ir AS a, f - vis AS b, vis, ir FROM fx),
c AS (SELECT pair_id, covar_pop(a, vis) * count(*) / (sqrt(var_pop(a) * count(*) * var_pop(vis) * count(*)) + 1e-12) + covar_pop(b, ir) * count(*) / (sqrt(var_pop(b) * count(*) * var_pop(ir) * count(*)) + 1e-12) AS scd FROM w GROUP BY 1)
SELECT split_part(pair_id, ':', 1) AS candidate, {r6("avg(ssim + qabf + 0.5 * scd - nabf)", "fitness")} FROM ss JOIN qe USING (pair_id) JOIN c USING (pair_id) GROUP BY 1""")
def fitness_edges(spark, sf_dir):
    held = sweep.clipped(candidate_rows(spark))
    return sweep.SourceStore(pixels(spark, sf_dir)).fitness("edges", classic=True)(held).withColumn("fitness", rounded(F.col("fitness")))


#: The thirteen published m of the fitness curve.
CURVE = (0.05, 0.0703, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0)


def curve(spark, px, r):
    """candidate, m, edges and information by the proposal, classic: information by the classic operator; over all pairs."""
    c = spark.createDataFrame([(f"{m:.4f}", r, m) for m in CURVE], "candidate string, r int, m double")
    store = sweep.SourceStore(px)
    proposal = store.fitnesses(c)
    classic = store.fitness("information", classic=True)(c).withColumnRenamed("fitness", "classic")
    return proposal.join(classic, "candidate").withColumn("m", F.col("candidate").cast("double"))


@query("o06_fitness_curve")
def fitness_curve(spark, sf_dir):
    """The three published curves at one radius that fits 8 x 8 pairs; the parts have SQL above."""
    return curve(spark, pixels(spark, sf_dir), 3)


@query("o06_fitness_curve_raster")
def fitness_curve_raster(spark, sf_dir):
    """The same at the published radius on the 64 x 64 pairs."""
    return curve(spark, raster(spark, sf_dir), 25)
