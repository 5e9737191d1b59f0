"""Fusion methods: a pixel relation (pair_id, y, x, vis, ir) to (pair_id, y, x, vis, ir, f)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import by_activity, clip01, farthest_from_one, max_abs
from ..sources.staging import staged
from . import filters, morphology, tiles, whole

SOURCES = ["vis", "ir"]
OUT = ("pair_id", "y", "x", "vis", "ir", "f")


def average(px: DataFrame) -> DataFrame:
    """Mean of the sources (F1)."""
    return px.withColumn("f", 0.5 * (F.col("vis") + F.col("ir"))).select(*OUT)


def _add_details(px: DataFrame, m: float) -> DataFrame:
    base = 0.5 * (F.col("vis") + F.col("ir"))
    bright, dark = F.greatest("vis_wth", "ir_wth"), F.greatest("vis_bth", "ir_bth")  # F2
    return px.withColumn("f", clip01(base + m * bright - m * dark)).select(*OUT)


def weighted_top_hat(px: DataFrame, r: float = 3, m: float = 1.0, mode: str = "sum", tile: int | None = None) -> DataFrame:
    """Mean of the sources plus m times the larger bright and less m times the larger dark details.

    tile: side of the tiles that large images are cut into; an opening reaches 2 r far.
    """
    if tile is None:
        return _add_details(morphology.combined_top_hats(px, SOURCES, r, mode), m)
    reach = 2 * max(1, round(r))
    return _add_details(tiles.tiled(px, lambda part, keys: morphology.combined_top_hats(part, SOURCES, r, mode, keys), max(tile, reach), reach), m)


def classic_top_hat(px: DataFrame, r: float = 5, m: float = 1.0) -> DataFrame:
    """The same with the disk only (F8)."""
    return _add_details(morphology.top_hats(px, SOURCES, "disk", r), m)


def laplacian(px: DataFrame, levels: int = 4) -> DataFrame:
    """Per level the source with the larger smoothed activity; the mean at the base (F9). Levels and chosen details are written tables."""
    g = filters.gaussian_pyramid(px, SOURCES, levels, cut=staged)
    fused = []
    for fine, coarse in zip(g, g[1:]):
        level = filters.laplacian_level(fine, coarse, SOURCES)
        act = level.withColumns({f"{c}_act": F.abs(c) for c in SOURCES})
        act = filters.separable(act, ["vis_act", "ir_act"], filters.PYRAMID_TAPS)  # N12
        fused.append(staged(act.select("pair_id", "y", "x", by_activity(F.col("vis_act"), F.col("ir_act"), F.col("vis"), F.col("ir")).alias("f"))))
    fused.append(g[-1].select("pair_id", "y", "x", (0.5 * (F.col("vis") + F.col("ir"))).alias("f")))
    return _with_sources(px, filters.reconstruct(fused, ["f"]))


def ratio(px: DataFrame, levels: int = 4, eps: float = 1e-6) -> DataFrame:
    """Pyramid of ratios to the blown-up next level, the one farther from 1; multiplied up from the mean base (F10). Levels are written tables."""
    g = filters.gaussian_pyramid(px, SOURCES, levels + 1, cut=staged)
    out = g[-1].select("pair_id", "y", "x", (0.5 * (F.col("vis") + F.col("ir"))).alias("f"))
    for fine, coarse in zip(reversed(g[:-1]), reversed(g[1:])):
        both = filters.aligned([(coarse, SOURCES), (out, ["f"])])
        r = filters.with_up(fine, both, SOURCES, [*SOURCES, "f"])
        vis, ir = ((F.col(c) + eps) / (F.col(f"_{c}_up") + eps) for c in SOURCES)
        out = staged(r.select("pair_id", "y", "x", (farthest_from_one(vis, ir) * (F.col("_f_up") + eps)).alias("f")))
    return _with_sources(px, out)


def haar(px: DataFrame, levels: int = 3) -> DataFrame:
    """Haar details farther from 0, mean approximation."""
    details, approx = [], px.select("pair_id", "y", "x", *SOURCES)
    for _ in range(levels):
        bands = filters.haar_split(approx, SOURCES)
        details.append(bands.where("band <> 'A'").select("pair_id", "band", "y", "x", max_abs(F.col("vis"), F.col("ir")).alias("f")))  # F3
        approx = bands.where("band = 'A'").drop("band")
    out = approx.select("pair_id", F.lit("A").alias("band"), "y", "x", (0.5 * (F.col("vis") + F.col("ir"))).alias("f"))  # F6
    for level in reversed(details):
        # cells past an odd side have no details at the finer level: an inner size is kept by the semi join
        cells = level.select("pair_id", "y", "x").distinct()
        out = filters.haar_join(out.join(cells, ["pair_id", "y", "x"], "left_semi").unionByName(level), ["f"]).select("pair_id", F.lit("A").alias("band"), "y", "x", "f")
    return _with_sources(px, out.drop("band"))


def _with_sources(px: DataFrame, fused: DataFrame) -> DataFrame:
    return filters.aligned([(px, SOURCES), (fused.withColumn("f", clip01(F.col("f"))), ["f"])]).select(*OUT)


class OnImages:
    """A method over whole images (``operators/whole.py``): no table between steps, and ``fan_out`` takes all of them in one pass."""

    def __init__(self, kernel: Callable):
        self.kernel = kernel

    def __call__(self, px: DataFrame) -> DataFrame:
        return fan_out(px, {"": self}).select(*OUT)


#: Name -> method with the parameters of the benchmark (F14); the sources themselves count as methods where detection needs them.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "proposal": OnImages(partial(whole.weighted_top_hat, r=25, m=0.0703)),
    "classic": OnImages(partial(whole.classic_top_hat, r=5, m=1.0)),
    "laplacian": OnImages(partial(whole.laplacian, levels=4)),
    "ratio": OnImages(partial(whole.ratio, levels=4)),
    "haar": OnImages(partial(whole.haar, levels=3)),
    "db4": OnImages(partial(whole.db4, levels=3)),
    "dual_tree": OnImages(partial(whole.dual_tree, levels=4)),
    "average": average,
    "vis": lambda px: px.withColumn("f", F.col("vis")).select(*OUT),
    "ir": lambda px: px.withColumn("f", F.col("ir")).select(*OUT),
}


def fan_out(px: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """method, pair_id, y, x, vis, ir, f of all methods."""
    kernels = {name: method.kernel for name, method in methods.items() if isinstance(method, OnImages)}
    parts = [method(px).withColumn("method", F.lit(name)) for name, method in methods.items() if name not in kernels]
    if kernels:
        named = F.arrays_zip(F.array(*[F.lit(name) for name in kernels]).alias("method"), F.col("fs").alias("f"))
        fs = whole.fused(px, kernels).select("*", F.explode(named).alias("_m"))
        parts.append(fs.select(*OUT[:-1], F.col("_m.f").alias("f"), F.col("_m.method").alias("method")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("method", *OUT)
