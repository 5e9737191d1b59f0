"""Labelled detection sets and detection scores as tables of boxes (image_id, class_id, cx, cy, w, h), sides relative to the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ordering import numbered as numbered_rows

#: Tells the boxes of an image apart, whatever ids repeat.
GT_ORDER = ("class_id", "box_id", "cx", "cy", "w", "h")
SLOTS = 1000
ANNOTATION = "size struct<width:double,height:double>, object array<struct<name:string, bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def parse_annotations(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """rows with one row per object: name, xmin, ymin, xmax, ymax, width, height; malformed XML has none."""
    a = rows.withColumn("_a", F.from_xml(F.col(xml), ANNOTATION, {"rowTag": "annotation", "mode": "PERMISSIVE"})).drop(xml)
    a = a.withColumn("_o", F.explode("_a.object"))
    return a.select(*[c for c in a.columns if not c.startswith("_")], F.col("_o.name").alias("name"), "_o.bndbox.*", F.col("_a.size.width").alias("width"), F.col("_a.size.height").alias("height"))


def to_boxes(objects: DataFrame, names: tuple[str, ...] | None, default: tuple[float, float] = (1024.0, 768.0)) -> DataFrame:
    """Relative boxes, 6 digits, of positive size; class by place in names, unknown names dropped (D1), or 0 for all without names.

    An image size that is missing or 0 is the default one.
    """
    width, height = (F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d)) for c, d in zip(("width", "height"), default))
    o = objects.withColumn("class_id", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int") - 1 if names else F.lit(0))
    o = o.where("class_id >= 0").select(
        "image_id", "class_id",
        F.round((F.col("xmin") + F.col("xmax")) / 2.0 / width, 6).alias("cx"), F.round((F.col("ymin") + F.col("ymax")) / 2.0 / height, 6).alias("cy"),
        F.round((F.col("xmax") - F.col("xmin")) / width, 6).alias("w"), F.round((F.col("ymax") - F.col("ymin")) / height, 6).alias("h"),
    )
    return o.where("w > 0 AND h > 0")


def format_labels(boxes: DataFrame) -> DataFrame:
    """image_id, label: a line "class cx cy w h" per box, 6 digits, in order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    return boxes.groupBy("image_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("label"))


def parse_labels(labels: DataFrame) -> DataFrame:
    """Boxes of label texts; blank lines are dropped."""
    lines = labels.select("image_id", F.explode(F.split("label", "\n")).alias("line")).where(F.trim("line") != "")
    f = F.split(F.trim("line"), r"\s+")
    return lines.select("image_id", f[0].cast("int").alias("class_id"), *[f[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def manifest(boxes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: number of all classes and their names in order, so that every split gives a class the same number; and how many are seen."""
    return boxes.agg(F.lit(len(names)).alias("nc"), F.array(*[F.lit(n) for n in names]).alias("names"), F.count_distinct("class_id").alias("seen"))


def head_split(images: DataFrame, train: int, val: int, key: str = "image_id") -> DataFrame:
    """The first train rows in key order, then val; others are left out (D3)."""
    n = numbered_rows(images, key, name="_rn")
    return n.where(F.col("_rn") <= train + val).withColumn("split", F.when(F.col("_rn") <= train, "train").otherwise("val")).drop("_rn")


def share_split(images: DataFrame, share: float = 0.8, limits: dict[str, int] | None = None, key: str = "image_id") -> DataFrame:
    """The first share of the rows in key order is train, the rest val; at most limits[split] of each."""
    n = numbered_rows(images, key, name="_rn").crossJoin(F.broadcast(images.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    cut = F.floor(F.col("_n") * share)
    n = n.withColumns({"split": F.when(F.col("_rn") <= cut, "train").otherwise("val"), "_at": F.when(F.col("_rn") <= cut, F.col("_rn")).otherwise(F.col("_rn") - cut)})
    for name, most in (limits or {}).items():
        n = n.where((F.col("split") != name) | (F.col("_at") <= most))
    return n.drop("_rn", "_n", "_at")


def rename_split(split: Column) -> Column:
    """train stays, test is val, others are dropped as null."""
    return F.when(split == "train", "train").when(split == "test", "val")


def mixed_modality(boxes: DataFrame, modalities: tuple[str, ...] = ("vi", "ir")) -> DataFrame:
    """Each image's boxes once per modality, with the name image__modality."""
    return boxes.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in modalities]))).withColumn("image", F.concat_ws("__", F.col("image_id").cast("string"), "modality"))


def fan_out_labels(boxes: DataFrame, methods: list[str]) -> DataFrame:
    """One label set for every method."""
    return boxes.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def class_counts(pred: DataFrame, classes: dict[str, int], confidence: float = 0.3) -> DataFrame:
    """image_id, method, a count per class of the predictions that are sure enough."""
    return pred.groupBy("image_id", "method").agg(*[F.count_if((F.col("conf") >= confidence) & (F.col("class_id") == k)).alias(name) for name, k in classes.items()])


def candidate_scenes(gt: DataFrame, least: dict[int, int]) -> DataFrame:
    """Images with so many boxes of each class at least (P10)."""
    g = gt.groupBy("image_id").agg(*[F.count_if(F.col("class_id") == k).alias(f"_n{k}") for k in least])
    for k, n in least.items():
        g = g.where(F.col(f"_n{k}") >= n)
    return g.select("image_id")


def pick_scenes(scores: DataFrame, first: str, second: str) -> DataFrame:
    """One row: the image with the largest first score, and of the others the one with the largest second; smallest id on a tie."""
    a = scores.agg(F.min_by("image_id", F.struct(-F.col(first), F.col("image_id"))).alias("first_image"))
    rest = scores.join(F.broadcast(a), F.col("image_id") != F.col("first_image"))
    return rest.groupBy("first_image").agg(F.min_by("image_id", F.struct(-F.col(second), F.col("image_id"))).alias("second_image"))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given by cx, cy, w, h; 0 for two without area."""
    side = lambda c, s: F.greatest(F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2), F.lit(0.0))
    both = side("cx", "w") * side("cy", "h")
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def candidate_matches(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """method, image_id, class_id, pred_no, gt_no, conf, iou of all pairs in an image and class that overlap enough."""
    g = gt.select("image_id", "class_id", "gt_no", *[F.col(c).alias(f"g_{c}") for c in ("cx", "cy", "w", "h")])
    iou = overlap({c: F.col(c) for c in ("cx", "cy", "w", "h")}, {c: F.col(f"g_{c}") for c in ("cx", "cy", "w", "h")})
    return pred.join(g, ["image_id", "class_id"]).withColumn("iou", iou).where(F.col("iou") >= least).select("method", "image_id", "class_id", "pred_no", "gt_no", "conf", "iou")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a number that tells rows of an image apart, whatever ids repeat."""
    by = ["method", "image_id"] if "method" in df.columns else ["image_id"]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def taken(least: float) -> Column:
    """The predictions that take a box at an overlap, from the sorted candidates c of a group."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        F.filter("c", lambda x: -x["far"] >= least), F.struct(none.alias("p"), none.alias("g")),
        lambda s, x: F.when(F.array_contains(s["p"], x["pred_no"]) | F.array_contains(s["g"], x["gt_no"]), s).otherwise(
            F.struct(F.array_append(s["p"], x["pred_no"]).alias("p"), F.array_append(s["g"], x["gt_no"]).alias("g"))
        ),
    )["p"]


def match(candidates: DataFrame, overlaps: tuple[float, ...] = (0.5,)) -> DataFrame:
    """method, image_id, class_id, pred_no, hits of the true positives: predictions, surest first, take the best box still free.

    hits says for each overlap whether the prediction is one there. Greedy matching is sequential within an image and
    class, a small group: its sorted candidates are gathered once and folded for every overlap over those that reach it.
    """
    c = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("sure"), "pred_no", (-F.col("iou")).alias("far"), "gt_no")))
    g = candidates.groupBy("method", "image_id", "class_id").agg(c.alias("c"))
    g = g.select("method", "image_id", "class_id", F.array(*[taken(o) for o in overlaps]).alias("taken"))
    g = g.withColumn("pred_no", F.explode(F.array_distinct(F.flatten("taken"))))
    return g.select("method", "image_id", "class_id", "pred_no", F.transform("taken", lambda t: F.array_contains(t, F.col("pred_no"))).alias("hits"))


def _judged(gt: DataFrame, pred: DataFrame, overlaps: tuple[float, ...]) -> DataFrame:
    """method, image_id, class_id, pred_no, conf, hits of all predictions; hits as ``match`` gives them.

    Boxes of both sides are written once, in one table in buckets by image; numbers, overlaps and matching are windows and groups over
    more keys than that, so rows aren't dealt anew, where joins by image and class, then by prediction, would do it for all of them.
    """
    side = ("cx", "cy", "w", "h")
    both = gt.select(F.lit(True).alias("truth"), "image_id", *GT_ORDER).unionByName(pred.select(F.lit(False).alias("truth"), "method", "image_id", *GT_ORDER, "conf"), allowMissingColumns=True)
    both = staged(both, ("image_id",), shuffle=False)
    both = both.withColumn("no", F.row_number().over(Window.partitionBy("truth", "method", "image_id").orderBy(F.desc("conf"), *GT_ORDER)))
    real = F.col("truth") & F.col("image_id").isNotNull() & F.col("class_id").isNotNull()
    of = F.collect_list(F.when(real, F.struct("no", *side)))
    p = both.withColumn("gs", of.over(Window.partitionBy("image_id", "class_id"))).where("NOT truth")
    iou = lambda g: overlap({c: F.col(c) for c in side}, {c: g[c] for c in side})
    near = F.transform("gs", lambda g: F.struct((-F.col("conf")).alias("sure"), F.col("no").alias("pred_no"), (-iou(g)).alias("far"), g["no"].alias("gt_no")))
    p = p.withColumn("near", F.filter(near, lambda x: -x["far"] >= min(overlaps)))
    g = p.groupBy("method", "image_id", "class_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("c"), F.collect_list(F.struct(F.col("no").alias("pred_no"), "conf")).alias("ps"))
    g = g.select("method", "image_id", "class_id", "ps", F.array(*[taken(o) for o in overlaps]).alias("taken"))
    g = g.select("method", "image_id", "class_id", "taken", F.explode("ps").alias("p")).select("method", "image_id", "class_id", "taken", "p.*")
    return g.select("method", "image_id", "class_id", "pred_no", "conf", F.transform("taken", lambda t: F.array_contains(t, F.col("pred_no"))).alias("hits"))


def average_precisions(gt: DataFrame, pred: DataFrame, overlaps: tuple[float, ...] = (0.5,)) -> DataFrame:
    """method, class_id, overlap, ap, n_gt, tp, fp: average precision at each overlap, by 101 recall points.

    One pass for all overlaps: boxes are numbered, matched and ranked once, and the running counts of all overlaps are
    columns of the same windows. Boxes are written once in buckets by image, and predictions once more, without their boxes, by slot;
    what lies between needs no shuffle.
    """
    p = _judged(gt, pred, overlaps)
    ks = range(len(overlaps))
    p = p.withColumns({f"hit{k}": F.coalesce(F.get("hits", F.lit(k)), F.lit(False)).cast("int") for k in ks}).drop("hits")
    # running counts in two steps: over slots of confidence, of which a class has at most SLOTS + 1, and within each slot
    slot = ["method", "class_id", "_slot"]
    p = staged(p.withColumn("_slot", F.floor((1 - F.least(F.greatest(F.col("conf"), F.lit(0.0)), F.lit(1.0))) * SLOTS).cast("int")), tuple(slot), shuffle=False)
    before = Window.partitionBy("method", "class_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"hit{k}").alias(f"_h{k}") for k in ks])
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = starts.select(*slot, sofar("_n").alias("_at"), *[sofar(f"_h{k}").alias(f"_tp{k}") for k in ks])
    by = Window.partitionBy(*slot).orderBy(F.desc("conf"), "image_id", "pred_no")
    within = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumns({f"_in{k}": F.sum(f"hit{k}").over(within) for k in ks} | {"_pos": F.row_number().over(by)})
    n_gt = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = p.join(starts, slot).join(F.broadcast(n_gt), "class_id")  # a row for each class
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").alias("hit"), (F.col(f"_tp{k}") + F.col(f"_in{k}")).alias("tp")) for k in ks])
    p = p.select("method", "class_id", "n_gt", (F.col("_at") + F.col("_pos")).alias("at"), F.explode(each).alias("o")).select("method", "class_id", "n_gt", "at", "o.*")
    # the precision envelope at 101 recall points: the largest precision at any recall that reaches the point
    point = F.floor(F.col("tp") / F.col("n_gt") * 100 + 1e-9).cast("int")
    best = p.groupBy("method", "class_id", "k", point.alias("point")).agg(F.max(F.col("tp") / F.col("at")).alias("precision"), F.max("n_gt").alias("n_gt"), F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp"))
    best = staged(best, ("method", "class_id", "k"))  # at most 101 rows for each of these
    counts = best.groupBy("method", "class_id", "k").agg(F.max("n_gt").alias("n_gt"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    frame = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(100)))).join(best.select("method", "class_id", "k", "point", "precision"), ["method", "class_id", "k", "point"], "left")
    envelope = F.max("precision").over(Window.partitionBy("method", "class_id", "k").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ap = frame.withColumn("e", F.coalesce(envelope, F.lit(0.0))).groupBy("method", "class_id", "k").agg(F.avg("e").alias("ap"), *[F.max(c).alias(c) for c in ("n_gt", "tp", "fp")])
    return ap.select("method", "class_id", F.element_at(F.array(*[F.lit(o) for o in overlaps]), F.col("k") + 1).alias("overlap"), "ap", "n_gt", "tp", "fp")


def average_precision(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """method, class_id, ap, n_gt, tp, fp at one overlap."""
    return average_precisions(gt, pred, (least,)).drop("overlap")


def scores(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """method, map50, precision, recall over the classes at an overlap of 0.5."""
    ap = average_precision(gt, pred)
    return ap.groupBy("method").agg(F.avg("ap").alias("map50"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("precision"), (F.sum("tp") / F.sum("n_gt")).alias("recall"))


def mean_ap(gt: DataFrame, pred: DataFrame, overlaps: tuple[float, ...] = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))) -> DataFrame:
    """method, map50_95: mean over overlaps and classes."""
    return average_precisions(gt, pred, overlaps).groupBy("method").agg(F.avg("ap").alias("map50_95"))


def wide_ap(ap: DataFrame, names: dict[int, str]) -> DataFrame:
    """method, AP50_<class> for the classes given."""
    w = ap.withColumn("name", F.element_at(F.create_map(*[x for k, n in names.items() for x in (F.lit(k), F.lit(f"AP50_{n}"))]), F.col("class_id")))
    return w.groupBy("method").pivot("name", [f"AP50_{n}" for n in names.values()]).agg(F.first("ap"))


def complementary_mean(ap: DataFrame, classes: tuple[int, ...], single: tuple[str, ...]) -> DataFrame:
    """method, mean over two classes, and whether it beats every single modality."""
    m = ap.where(F.col("class_id").isin(*classes)).groupBy("method").agg(F.avg("ap").alias("mean"))
    best = m.where(F.col("method").isin(*single)).agg(F.max("mean").alias("best_single"))  # one row
    return m.crossJoin(F.broadcast(best)).withColumn("beats_single", F.col("mean") > F.col("best_single"))
