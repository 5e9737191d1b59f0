"""Orthogonal wavelets and a dual tree of them on pixel relations, as lags over sorted places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip01, max_abs
from ..sources.staging import staged
from .filters import _padded, aligned, weighted_sum

KEYS = ("pair_id",)
#: Low-pass reconstruction taps of the Daubechies wavelet with four vanishing moments (fixed values).
DB4 = (
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
)
BANDS = ("LL", "LH", "HL", "HH")
#: Low-pass taps of both trees of a dual-tree transform (fixed, published values): ten taps of the first level, a place
#: apart, and the quarter-shift pair of the others, one the other's reverse.
FIRST_A = (0.0, -0.08838834764832, 0.08838834764832, 0.695879989034, 0.695879989034, 0.08838834764832, -0.08838834764832, 0.01122679215254, 0.01122679215254, 0.0)
FIRST_B = (0.01122679215254, 0.01122679215254, -0.08838834764832, 0.08838834764832, 0.695879989034, 0.695879989034, 0.08838834764832, -0.08838834764832, 0.0, 0.0)
QUARTER_A = (0.03516384, 0.0, -0.08832942, 0.23389032, 0.76027237, 0.5875183, 0.0, -0.11430184, 0.0, 0.0)
QUARTER_B = QUARTER_A[::-1]
Taps = tuple[float, ...]
Bank = tuple[Taps, Taps]


def _filters(low: Taps) -> dict[str, Taps]:
    """Synthesis taps of both halves; analysis uses them reversed."""
    n = len(low)
    return {"L": low, "H": tuple((-1.0) ** (n - j) * low[n - 1 - j] for j in range(n))}


def _look(px: DataFrame, columns: list[str], w: Window, shift: Callable, reach: int) -> DataFrame:
    """px with _p0, _p1, ...: a struct of the columns here and at 1 to reach places beside; one window expression a place, whatever the columns."""
    px = px.withColumn("_p0", F.struct(*columns))
    return px.withColumns({f"_p{j}": shift("_p0", j).over(w) for j in range(1, reach + 1)})


def _analyse(px: DataFrame, jobs: dict[str, tuple[str, Taps]], axis: str, keys: tuple[str, ...]) -> DataFrame:
    """keys and place at half the places along axis, with <new>L and <new>H for each new -> (column, low-pass taps); the border is mirrored with its edge repeated."""
    n, other = len(next(iter(jobs.values()))[1]), "x" if axis == "y" else "y"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    px = _look(_padded(px, axis, n - 1, "symmetric", keys), sorted({c for c, _ in jobs.values()}), w, F.lag, n - 1)
    px = px.where((F.col(axis) % 2 == 1) & (F.col(axis) > 0) & (F.col(axis) <= F.col("_last") + n - 1))
    total = lambda c, taps: weighted_sum([(t, f"_p{n - 1 - j}", c) for j, t in enumerate(taps) if t])
    out = [total(c, taps).alias(f"{new}{half}") for new, (c, low) in jobs.items() for half, taps in _filters(low).items()]
    return px.select(*keys, other, ((F.col(axis) - 1) / 2).cast("int").alias(axis), *out)


def _synthesise(px: DataFrame, jobs: dict[str, Taps], axis: str, keys: tuple[str, ...]) -> DataFrame:
    """The inverse: columns from <column>L and <column>H at twice the places; a few past the end are the caller's to drop."""
    n, other = len(next(iter(jobs.values()))), "x" if axis == "y" else "y"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    px = _look(px, [f"{c}{half}" for c in jobs for half in "LH"], w, F.lead, n // 2 - 1)
    px = px.withColumn("_last", F.max(axis).over(Window.partitionBy(*keys, other))).where(F.col(axis) <= F.col("_last") - (n // 2 - 1))

    def total(c: str, low: Taps, odd: int) -> Column:
        return weighted_sum([(taps[2 * i + odd], f"_p{n // 2 - 1 - i}", f"{c}{half}") for half, taps in _filters(low).items() for i in range(n // 2) if taps[2 * i + odd]])

    both = F.array(*[F.struct((2 * F.col(axis) + odd).alias(axis), *[total(c, low, odd).alias(c) for c, low in jobs.items()]) for odd in (0, 1)])
    return px.select(*keys, other, F.explode(both).alias("_p")).select(*keys, other, "_p.*")


def split(px: DataFrame, columns: list[str], low_x: Taps = DB4, low_y: Taps | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One level: keys, y, x and <column>_LL, _LH, _HL, _HH, first letter along x."""
    px = _analyse(px, {c: (c, low_x) for c in columns}, "x", keys)
    px = _analyse(px, {f"{c}_{h}": (f"{c}{h}", low_y or low_x) for c in columns for h in "LH"}, "y", keys)
    return px.select(*keys, "y", "x", *[f"{c}_{b}" for c in columns for b in BANDS])


def join(bands: DataFrame, columns: list[str], low_x: Taps = DB4, low_y: Taps | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The inverse of split."""
    px = _synthesise(bands, {f"{c}_{h}": low_y or low_x for c in columns for h in "LH"}, "y", keys)
    px = _synthesise(px.withColumnsRenamed({f"{c}_{h}": f"{c}{h}" for c in columns for h in "LH"}), {c: low_x for c in columns}, "x", keys)
    return px.select(*keys, "y", "x", *columns)


def _finish(px: DataFrame, fused: DataFrame) -> DataFrame:
    fused = fused.withColumn("f", clip01(F.col("f")))
    return aligned([(px, ["vis", "ir"]), (fused, ["f"])]).select(*KEYS, "y", "x", "vis", "ir", "f")


def db4_fusion(px: DataFrame, levels: int = 3) -> DataFrame:
    """Details farther from 0, mean approximation, by the db4 wavelet (F12). Every level is a written table."""
    details, approx = [], px
    for _ in range(levels):
        level = split(approx, ["vis", "ir"])
        pick = [max_abs(F.col(f"vis_{b}"), F.col(f"ir_{b}")).alias(f"f_{b}") for b in BANDS[1:]]
        details.append(staged(level.select(*KEYS, "y", "x", "vis_LL", "ir_LL", *pick)))
        approx = details[-1].select(*KEYS, "y", "x", F.col("vis_LL").alias("vis"), F.col("ir_LL").alias("ir"))
    out = approx.select(*KEYS, "y", "x", (0.5 * (F.col("vis") + F.col("ir"))).alias("f"))
    for level in reversed(details):
        out = join(aligned([(level, [f"f_{b}" for b in BANDS[1:]]), (out.withColumnRenamed("f", "f_LL"), ["f_LL"])]), ["f"])
    return _finish(px, out)


TREES = ("aa", "ab", "ba", "bb")


def dual_tree_bands(px: DataFrame, columns: list[str], levels: int = 4, first: Bank = (FIRST_A, FIRST_B), bank: Bank = (QUARTER_A, QUARTER_B)) -> list[DataFrame]:
    """Each level's keys, y, x, <column>_<tree>_<band>: four real transforms, tree a or b along x and along y, side by side.

    first, bank: low-pass taps of trees a and b at the first level and at the others. The trees are columns of one
    relation: a level is one chain of two windows for all of them and a written table, from which the next level starts.
    """
    out: list[DataFrame] = []
    for i in range(levels):
        low = dict(zip("ab", bank if i else first))
        if i:  # every tree goes on from its own approximation
            along_x = _analyse(out[-1], {f"{c}_{t}": (f"{c}_{t}_LL", low[t[0]]) for c in columns for t in TREES}, "x", KEYS)
            source = lambda c, t: f"{c}_{t}"
        else:
            along_x = _analyse(px, {f"{c}_{t}": (c, low[t]) for c in columns for t in "ab"}, "x", KEYS)
            source = lambda c, t: f"{c}_{t[0]}"
        jobs = {f"{c}_{t}_{h}": (f"{source(c, t)}{h}", low[t[1]]) for c in columns for t in TREES for h in "LH"}
        out.append(staged(_analyse(along_x, jobs, "y", KEYS)))
    return out


def directional(column: str, band: str) -> dict[int, tuple[Column, Column]]:
    """Both complex bands, real and imaginary part, that a band's four real ones combine to: six over the three bands."""
    v = {t: F.col(f"{column}_{t}_{band}") for t in TREES}
    return {1: (v["aa"] - v["bb"], v["ab"] + v["ba"]), -1: (v["aa"] + v["bb"], v["ab"] - v["ba"])}


def dual_tree_image(details: list[DataFrame], approx: DataFrame, first: Bank = (FIRST_A, FIRST_B), bank: Bank = (QUARTER_A, QUARTER_B)) -> DataFrame:
    """keys, y, x, f: the mean of the four trees' images, from levels with f_<tree>_<band> and the last approximation's f_<tree>_LL."""
    out = approx
    for i in range(len(details) - 1, -1, -1):
        low, own = dict(zip("ab", bank if i else first)), [f"f_{t}_{b}" for t in TREES for b in BANDS[1:]]
        px = aligned([(details[i], own), (out, [f"f_{t}_LL" for t in TREES])])
        px = _synthesise(px, {f"f_{t}_{h}": low[t[1]] for t in TREES for h in "LH"}, "y", KEYS)
        px = px.withColumnsRenamed({f"f_{t}_{h}": f"f_{t}{h}" for t in TREES for h in "LH"})
        px = _synthesise(px, {f"f_{t}": low[t[0]] for t in TREES}, "x", KEYS)
        out = staged(px.withColumnsRenamed({f"f_{t}": f"f_{t}_LL" for t in TREES}))
    return out.select(*KEYS, "y", "x", (sum((F.col(f"f_{t}_LL") for t in TREES), F.lit(0.0)) / 4.0).alias("f"))


def dual_tree_fusion(px: DataFrame, levels: int = 4, first: Bank = (FIRST_A, FIRST_B), bank: Bank = (QUARTER_A, QUARTER_B)) -> DataFrame:
    """Of both sources' six complex directional bands the one with the larger modulus, mean approximation."""
    details = []
    for level in dual_tree_bands(px, ["vis", "ir"], levels, first, bank):
        out = {}
        for b in BANDS[1:]:
            vis, ir, pick = directional("vis", b), directional("ir", b), {}
            for sign in (1, -1):
                (rv, iv), (ri, ii) = vis[sign], ir[sign]
                wins = rv * rv + iv * iv >= ri * ri + ii * ii
                pick[sign] = (F.when(wins, rv).otherwise(ri), F.when(wins, iv).otherwise(ii))
            out |= {
                f"f_aa_{b}": (pick[1][0] + pick[-1][0]) / 2.0, f"f_bb_{b}": (pick[-1][0] - pick[1][0]) / 2.0,
                f"f_ab_{b}": (pick[1][1] + pick[-1][1]) / 2.0, f"f_ba_{b}": (pick[1][1] - pick[-1][1]) / 2.0,
            }
        details.append(level.select(*KEYS, "y", "x", *[v.alias(c) for c, v in out.items()], *[(0.5 * (F.col(f"vis_{t}_LL") + F.col(f"ir_{t}_LL"))).alias(f"f_{t}_LL") for t in TREES]))
    return _finish(px, dual_tree_image(details, details[-1].select(*KEYS, "y", "x", *[f"f_{t}_LL" for t in TREES]), first, bank))
