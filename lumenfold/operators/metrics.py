"""Image-quality metrics: fused pixel relations (keys..., y, x, vis, ir, f) to one row per key.

``evaluate`` and ``fast_pass`` take many metrics from one chain of windows and one grouped aggregate: all windows'
keys contain those of the image, so the chain needs no shuffle of its own, and the fused pixels are made once. Counts of
histogram bins are windows there too: a mean over pixels of the logarithm of the own bin's share is minus the entropy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip01, edge_preservation, level
from ..sources.staging import staged
from . import filters, whole

PAIR = ("pair_id",)
ONE_PASS = ("EN", "SD", "FE", "MG", "MI_vis", "MI_ir", "SF", "SSIM", "SCD", "FMI", "Qabf", "Nabf", "Q0", "QW", "QE")


def histogram(px: DataFrame, column: str, bins: int = 256, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, bin, n, p: shares of equal bins on [0, 1]; the last one is closed, values outside are dropped (M0)."""
    v = F.col(column)
    b = F.least(F.floor(v * float(bins)), F.lit(bins - 1)).cast("int")
    n = px.where((v >= 0) & (v <= 1)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def entropy(px: DataFrame, column: str, bins: int = 256, floor: float = 1e-12, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, value: entropy in bits; floor is added to every bin, empty ones too, and the shares scaled to 1 again (M1, M18 with 0)."""
    total = 1.0 + bins * floor
    q = (F.col("p") + floor) / total
    h = histogram(px, column, bins, keys).groupBy(*keys).agg(F.sum(-q * F.log2(q)).alias("h"), F.count(F.lit(1)).alias("k"))
    empty = -(bins - F.col("k")) * (floor / total) * F.log2(F.lit(floor / total)) if floor else F.lit(0.0)
    return h.select(*keys, (F.col("h") + empty).alias("value"))


def std_dev(px: DataFrame, column: str = "f", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Population standard deviation (M2)."""
    return px.groupBy(*keys).agg(F.stddev_pop(column).alias("value"))


def fusion_efficiency(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Entropy of the fused image over the mean of the sources' (M3)."""
    f, v, i = (entropy(px, c, keys=keys).withColumnRenamed("value", c) for c in ("f", "vis", "ir"))
    return f.join(v, list(keys)).join(i, list(keys)).select(*keys, (F.col("f") / ((F.col("vis") + F.col("ir")) / 2.0 + 1e-12)).alias("value"))


def mean_gradient(px: DataFrame, column: str = "f", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Mean length of the central-difference gradient (M4)."""
    g = filters.central_gradient(px, [column], keys)
    gx, gy = F.col(f"{column}_gx"), F.col(f"{column}_gy")
    return g.groupBy(*keys).agg(F.avg(F.sqrt(gx * gx + gy * gy)).alias("value"))


def _information(px: DataFrame, a: Column, b: Column, bins: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, mi, ha, hb of two columns cut into levels: one count of level pairs, marginals by windows over the counts."""
    joint = px.groupBy(*keys, level(a, bins).alias("a"), level(b, bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*keys, *by))
    joint = joint.withColumns({"all": total(), "na": total("a"), "nb": total("b")})
    p, pa, pb = (F.col(c) / F.col("all") for c in ("n", "na", "nb"))
    return joint.groupBy(*keys).agg(F.sum(p * F.log2(p / (pa * pb))).alias("mi"), F.sum(-p * F.log2(pa)).alias("ha"), F.sum(-p * F.log2(pb)).alias("hb"))


def mutual_information(px: DataFrame, a: str = "f", b: str = "vis", bins: int = 64, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Mutual information in bits of two images (M5)."""
    return _information(px, F.col(a), F.col(b), bins, keys).select(*keys, F.col("mi").alias("value"))


def spatial_frequency(px: DataFrame, column: str = "f", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Root of the mean squared row and column differences on the 0-255 scale (M6)."""
    v = clip01(F.col(column)) * 255.0
    px = px.withColumn("_v", v)
    d = {f"_d{a}": F.col("_v") - filters.beside("_v", a, -1, Window.partitionBy(*keys, o).orderBy(a)) for a, o in (("x", "y"), ("y", "x"))}
    return px.withColumns(d).groupBy(*keys).agg(F.sqrt(F.avg(F.col("_dx") * F.col("_dx")) + F.avg(F.col("_dy") * F.col("_dy"))).alias("value"))


def _edge_columns(px: DataFrame, f: str = "f") -> tuple[DataFrame, Column, Column]:
    """px with what it takes, and the aggregates Qabf and Nabf, from columns <c>_g and <c>_a of vis, ir and the image f."""
    g = {c: F.col(f"{c}_g") for c in ("vis", "ir")} | {"f": F.col(f"{f}_g")}
    q = {c: edge_preservation(g[c], F.col(f"{c}_a"), g["f"], F.col(f"{f}_a")) for c in ("vis", "ir")}
    px = px.withColumns({f"_{f}_qv": q["vis"], f"_{f}_qi": q["ir"]})
    qv, qi = F.col(f"_{f}_qv"), F.col(f"_{f}_qi")
    kept = qv * g["vis"] + qi * g["ir"]
    lost = (1 - qv) * g["vis"] + (1 - qi) * g["ir"]
    new = (g["f"] > g["vis"]) & (g["f"] > g["ir"])
    weight = F.sum(g["vis"] + g["ir"]) + 1e-12
    return px, F.sum(kept) / weight, F.sum(F.when(new, lost).otherwise(0.0)) / weight


def edge_quality(px: DataFrame, fast: bool = False, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, qabf, nabf: edges kept from the sources, and edges that neither has (M7; fast: the search's gradient)."""
    px, qabf, nabf = _edge_columns(filters.sobel(px, ["vis", "ir", "f"], fast, keys))
    return px.groupBy(*keys).agg(qabf.alias("qabf"), nabf.alias("nabf"))


def _moments(px: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, Column]:
    return {f"_{a}_{b}": F.col(a) * F.col(b) for a, b in pairs}


def ssim(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Mean of the similarity to both sources: 7 x 7 means, sample covariances, borders cropped (M8)."""
    px = px.withColumns(_moments(px, [("f", "f"), ("vis", "vis"), ("ir", "ir"), ("f", "vis"), ("f", "ir")]))
    cols = ["f", "vis", "ir", "_f_f", "_vis_vis", "_ir_ir", "_f_vis", "_f_ir"]
    m = filters.box_mean(px.select(*keys, "y", "x", *cols), cols, 7, "valid", keys)
    return m.groupBy(*keys).agg((0.5 * (F.avg(_ssim_at("vis", 49 / 48)) + F.avg(_ssim_at("ir", 49 / 48)))).alias("value"))


def _ssim_at(s: str, scale: float, eps: float = 0.0, mark: str = "", image: str = "f") -> Column:
    """Similarity at a place of an image and s from local means, whose names begin with mark."""
    c1, c2 = 0.01**2, 0.03**2
    f, x = F.col(f"{mark}{image}"), F.col(f"{mark}{s}")
    vf, vx, cov = ((F.col(mark + n) - p) * scale for n, p in ((f"_{image}_{image}", f * f), (f"_{s}_{s}", x * x), (f"_{image}_{s}", f * x)))
    return ((2 * f * x + c1) * (2 * cov + c2)) / ((f * f + x * x + c1) * (vf + vx + c2) + eps)


def ssim_fast(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """The search's similarity: Gaussian 11 x 11 with sigma 1.5, whole frame, population covariances."""
    px = px.withColumns(_moments(px, [("f", "f"), ("vis", "vis"), ("ir", "ir"), ("f", "vis"), ("f", "ir")]))
    cols = ["f", "vis", "ir", "_f_f", "_vis_vis", "_ir_ir", "_f_vis", "_f_ir"]
    m = filters.separable(px.select(*keys, "y", "x", *cols), cols, filters.gaussian_taps(11, 1.5), "mirror", keys)
    return m.groupBy(*keys).agg((0.5 * (F.avg(_ssim_at("vis", 1.0, 1e-12)) + F.avg(_ssim_at("ir", 1.0, 1e-12)))).alias("value"))


def correlation(a: Column, b: Column) -> Column:
    """Correlation aggregate that is 0, not null, for a constant image."""
    n = F.count(F.lit(1))
    return (F.covar_pop(a, b) * n) / (F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n) + 1e-12)


def _scd(image: str = "f") -> Column:
    f, v, i = F.col(image), F.col("vis"), F.col("ir")
    return correlation(f - i, v) + correlation(f - v, i)


def scd(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Sum of the correlations of each difference with the other source (M9)."""
    return px.groupBy(*keys).agg(_scd().alias("value"))


def _psnr_share(image: str = "f") -> Column:
    mse = lambda c: F.avg((F.col(image) - F.col(c)) * (F.col(image) - F.col(c)))
    return 10.0 * F.log10(1.0 / F.greatest(0.5 * (mse("vis") + mse("ir")), F.lit(1e-12))) / 100.0


def psnr_share(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """PSNR over the mean squared error to both sources, / 100."""
    return px.groupBy(*keys).agg(_psnr_share().alias("value"))


def feature_information(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Normalised mutual information of gradient features, mean over the sources."""
    e = filters.gradient_feature(px, ["f", "vis", "ir"], keys)
    parts = []
    for s in ("vis", "ir"):
        both = F.col("ha") + F.col("hb")
        parts.append(_information(e, F.col("f_e"), F.col(f"{s}_e"), 64, keys).select(*keys, F.when(both > 1e-12, 2 * F.col("mi") / both).otherwise(0.0).alias(s)))
    return parts[0].join(parts[1], list(keys)).select(*keys, (0.5 * (F.col("vis") + F.col("ir"))).alias("value"))


def local_means(px: DataFrame, taps: dict[int, float], border: str, keys: tuple[str, ...], of: dict[str, str], mark: str) -> DataFrame:
    """px with the local means of three images and of their products, as <mark>f, <mark>_f_f and so on; of: vis, ir and f -> column."""
    v = {c: F.col(of[c]) for c in ("f", "vis", "ir")}
    new = {f"{mark}{c}": x for c, x in v.items()} | {f"{mark}_{c}_{c}": x * x for c, x in v.items()} | {f"{mark}_f_{s}": v["f"] * v[s] for s in ("vis", "ir")}
    return filters.separable(px.withColumns(new), list(new), taps, border, keys)


def _local_columns(px: DataFrame, mark: str) -> DataFrame:
    """px with <mark>local, the quality index at a place, and <mark>c, its saliency, from local means."""
    m = lambda c: F.col(mark + c)
    px = px.withColumns({f"{mark}v_{c}": F.greatest(m(f"_{c}_{c}") - m(c) * m(c), F.lit(0.0)) for c in ("vis", "ir", "f")})

    def q(s: str) -> Column:
        x, f = m(s), m("f")
        num = 4.0 * (m(f"_f_{s}") - x * f) * x * f
        den = (m(f"v_{s}") + m("v_f")) * (x * x + f * f)
        return F.when(den > 1e-12, F.try_divide(num, den)).otherwise(1.0)

    share = m("v_vis") / (m("v_vis") + m("v_ir") + 1e-12)
    return px.withColumns({f"{mark}local": share * q("vis") + (1.0 - share) * q("ir"), f"{mark}c": F.greatest(m("v_vis"), m("v_ir"))})


def _weighted(mark: str) -> Column:
    return F.sum(F.col(f"{mark}c") * F.col(f"{mark}local")) / (F.sum(f"{mark}c") + 1e-12)


RAW, EDGE = ({c: c + end for c in ("vis", "ir", "f")} for end in ("", "_e"))


def local_quality(px: DataFrame, n: int = 7, alpha: float = 1.0, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, q0, qw, qe: local quality index, weighted by saliency, and times that of the edge maps."""
    px = filters.gradient_feature(px.select(*keys, "y", "x", "vis", "ir", "f"), ["vis", "ir", "f"], keys)
    for of, mark in ((RAW, "_p"), (EDGE, "_q")):
        px = _local_columns(local_means(px, filters.box_taps(n), "symmetric", keys, of, mark), mark)
    return px.groupBy(*keys).agg(F.avg("_plocal").alias("q0"), _weighted("_p").alias("qw"), (_weighted("_p") * F.pow(_weighted("_q"), F.lit(alpha))).alias("qe"))


def _vif_scale(px: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, num_<s>, den_<s> for both sources at one scale."""
    px = px.withColumns(_moments(px, [("f", "f"), ("vis", "vis"), ("ir", "ir"), ("vis", "f"), ("ir", "f")]))
    cols = ["f", "vis", "ir", "_f_f", "_vis_vis", "_ir_ir", "_vis_f", "_ir_f"]
    m = filters.separable(px.select(*keys, "y", "x", *cols), cols, filters.gaussian_taps(n, n / 5.0), "valid", keys)
    aggs = []
    for s in ("vis", "ir"):
        x, f = F.col(s), F.col("f")
        s1 = F.greatest(F.col(f"_{s}_{s}") - x * x, F.lit(0.0))
        s2 = F.greatest(F.col("_f_f") - f * f, F.lit(0.0))
        s12 = F.col(f"_{s}_f") - x * f
        m = m.withColumns({f"_s1_{s}": s1, f"_s2_{s}": s2, f"_s12_{s}": s12})
        s1, s2, s12 = F.col(f"_s1_{s}"), F.col(f"_s2_{s}"), F.col(f"_s12_{s}")
        low1, low2 = s1 < 1e-10, s2 < 1e-10
        g0 = s12 / (s1 + 1e-10)
        g = F.when(low1 | low2, 0.0).otherwise(g0)
        # the order of the guards counts: a flat source, then a flat image, then a negative gain
        sv = F.when(g < 0, s2).when(low2, 0.0).when(low1, s2).otherwise(s2 - g0 * s12)
        g, sv, s1 = F.greatest(g, F.lit(0.0)), F.greatest(sv, F.lit(1e-10)), F.when(low1, 0.0).otherwise(s1)
        aggs += [F.sum(F.log10(1.0 + g * g * s1 / (sv + 2.0))).alias(f"num_{s}"), F.sum(F.log10(1.0 + s1 / 2.0)).alias(f"den_{s}")]
    return m.groupBy(*keys).agg(*aggs)


def vif(px: DataFrame, scales: int = 4, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Pixel-domain visual information fidelity, mean over the sources (M11). No row for images that no window of the first scale fits; sides of 41 give all four."""
    px = px.select(*keys, "y", "x", *[(clip01(F.col(c)) * 255.0).alias(c) for c in ("vis", "ir", "f")])
    parts = []
    for scale in range(1, scales + 1):
        n = 2 ** (5 - scale) + 1
        if scale > 1:
            px = filters.separable(px, ["vis", "ir", "f"], filters.gaussian_taps(n, n / 5.0), "valid", keys)
            k = n // 2  # the valid area starts at k; every second place of it stays
            px = px.where(((F.col("x") - k) % 2 == 0) & ((F.col("y") - k) % 2 == 0)).withColumns({a: ((F.col(a) - k) / 2).cast("int") for a in "xy"})
            px = staged(px, keys)  # the scales from here on start from this one
        parts.append(_vif_scale(px, n, keys))
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(f"{p}_{s}").alias(f"{p}_{s}") for p in ("num", "den") for s in ("vis", "ir")])
    ratio = lambda s: F.col(f"num_{s}") / (F.col(f"den_{s}") + 1e-12)
    return total.select(*keys, (0.5 * (ratio("vis") + ratio("ir"))).alias("value"))


def _share(px: DataFrame, by: list[Column], keys: tuple[str, ...]) -> Column:
    """At each pixel, how many of its image's pixels have the same values."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys, *by)).cast("double")


def _bin(c: str, bins: int = 256) -> Column:
    """The bin of a value; null outside of [0, 1]."""
    v = F.col(c)
    return F.when((v >= 0) & (v <= 1), F.least(F.floor(v * float(bins)), F.lit(bins - 1)).cast("int"))


def _entropy_columns(px: DataFrame, columns: list[str], keys: tuple[str, ...], floor: float = 1e-12, bins: int = 256) -> tuple[DataFrame, dict[str, Column]]:
    """px with each pixel's count of its bin, and the aggregates: entropies as ``entropy`` gives."""
    px = px.withColumns({f"_b_{c}": _bin(c, bins) for c in columns})
    px = px.withColumns({f"_n_{c}": F.when(F.col(f"_b_{c}").isNotNull(), _share(px, [F.col(f"_b_{c}")], keys)) for c in columns})
    px = px.withColumns({f"_all_{c}": F.count(f"_b_{c}").over(Window.partitionBy(*keys)).cast("double") for c in columns})
    out, total = {}, 1.0 + bins * floor
    for c in columns:
        n, every = F.col(f"_n_{c}"), F.col(f"_all_{c}")
        q = (n / every + floor) / total
        kinds = F.sum(1.0 / n)
        empty = -(bins - kinds) * (floor / total) * F.log2(F.lit(floor / total)) if floor else F.lit(0.0)
        out[c] = F.sum(-q * F.log2(q) / n) + empty  # a bin's term is shared out to its n pixels
    return px, out


def _information_columns(px: DataFrame, pairs: list[tuple[str, str]], of: dict[str, str], mark: str, keys: tuple[str, ...], bins: int = 64) -> tuple[DataFrame, dict[tuple[str, str], tuple[Column, Column, Column]]]:
    """px with counts, and the aggregates of each pair of columns: mutual information and both entropies."""
    names = sorted({c for p in pairs for c in p})
    px = px.withColumns({f"{mark}l_{c}": level(F.col(of[c]), bins) for c in names})
    count = lambda *c: _share(px, [F.col(f"{mark}l_{x}") for x in c], keys)
    px = px.withColumns({f"{mark}n_{c}": count(c) for c in names} | {f"{mark}n_{a}_{b}": count(a, b) for a, b in pairs} | {f"{mark}all": _share(px, [], keys)})
    n = lambda *c: F.col(f"{mark}n_" + "_".join(c))
    every = F.col(f"{mark}all")
    return px, {(a, b): (F.avg(F.log2(n(a, b) * every / (n(a) * n(b)))), F.avg(-F.log2(n(a) / every)), F.avg(-F.log2(n(b) / every))) for a, b in pairs}


def fast_pass(px: DataFrame, keys: tuple[str, ...] = PAIR, edges: bool = True, information: bool = True) -> DataFrame:
    """keys and the search's measures in one pass: ssim (M17), and qabf, nabf, scd, or en (M18 without / 8) and psnr."""
    px = px.select(*keys, "y", "x", "vis", "ir", "f")
    out = {}
    if information:
        px, en = _entropy_columns(px, ["f"], keys, floor=0.0)
        out |= {"en": en["f"], "psnr": _psnr_share()}
    if edges:
        px, qabf, nabf = _edge_columns(filters.sobel(px, ["vis", "ir", "f"], True, keys))
        out |= {"qabf": qabf, "nabf": nabf, "scd": _scd()}
    px = local_means(px, filters.gaussian_taps(11, 1.5), "mirror", keys, RAW, "_m")
    out["ssim"] = 0.5 * (F.avg(_ssim_at("vis", 1.0, 1e-12, "_m")) + F.avg(_ssim_at("ir", 1.0, 1e-12, "_m")))
    return px.groupBy(*keys).agg(*[v.alias(n) for n, v in out.items()])


SEARCH_TAPS = filters.gaussian_taps(11, 1.5)


def source_features(px: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """px with what the search's measures need of the sources alone: <s>_g and <s>_a, and the local means _m<s> and _m_<s>_<s>."""
    px = filters.sobel(px.select(*keys, "y", "x", "vis", "ir"), ["vis", "ir"], True, keys)
    px = px.withColumns({f"_m{s}": F.col(s) for s in ("vis", "ir")} | {f"_m_{s}_{s}": F.col(s) * F.col(s) for s in ("vis", "ir")})
    return filters.separable(px, [f"_m{s}" for s in ("vis", "ir")] + [f"_m_{s}_{s}" for s in ("vis", "ir")], SEARCH_TAPS, "mirror", keys)


def fast_columns(px: DataFrame, images: list[str], keys: tuple[str, ...] = PAIR, edges: bool = True) -> DataFrame:
    """keys and measures: an array, one struct an image, of ssim (M17), psnr (M19) and, with edges, qabf, nabf and scd.

    px has ``source_features`` and the images as columns: all of them go through the same windows, and nothing of the sources
    is worked out again.
    """
    if edges:
        px = filters.sobel(px, images, True, keys)
    means = {f"_m{f}": F.col(f) for f in images} | {f"_m_{f}_{f}": F.col(f) * F.col(f) for f in images} | {f"_m_{f}_{s}": F.col(f) * F.col(s) for f in images for s in ("vis", "ir")}
    px = filters.separable(px.withColumns(means), list(means), SEARCH_TAPS, "mirror", keys)
    found = []
    for f in images:
        one = {"ssim": 0.5 * (F.avg(_ssim_at("vis", 1.0, 1e-12, "_m", f)) + F.avg(_ssim_at("ir", 1.0, 1e-12, "_m", f))), "psnr": _psnr_share(f)}
        if edges:
            px, one["qabf"], one["nabf"] = _edge_columns(px, f)
            one["scd"] = _scd(f)
        found.append(F.struct(*[v.alias(n) for n, v in one.items()]))
    return px.groupBy(*keys).agg(F.array(*found).alias("measures"))


def evaluate(px: DataFrame, with_vif: bool = True, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """One wide row per key with all metrics (M16): one pass over whole images for fifteen of them, one for VIF, which is null for images too small for it."""
    one = whole.measured(px, keys, list(ONE_PASS), whole.record)
    return one.join(vif(px, keys=keys).withColumnRenamed("value", "VIF"), list(keys), "left") if with_vif else one
