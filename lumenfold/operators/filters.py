"""Neighbourhood filters on pixel relations: separable taps with a border rule, gradients, box means, pyramids, wavelets."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PYRAMID_TAPS = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}
KEYS = ("pair_id",)


def gaussian_taps(n: int, sigma: float) -> dict[int, float]:
    """n taps of a Gaussian, summing to 1."""
    g = {d: math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-(n // 2), n // 2 + 1)}
    return {d: v / sum(g.values()) for d, v in g.items()}


def box_taps(n: int) -> dict[int, float]:
    return {d: 1 / n for d in range(-(n // 2), n // 2 + 1)}


def _padded(px: DataFrame, axis: str, k: int, border: str, keys: tuple[str, ...]) -> DataFrame:
    """px with its rows near the border repeated at mirrored places outside, and each line's first and last place as _first and _last.

    border: "mirror" (edge not repeated), "symmetric" (edge repeated), "valid" (nothing added). Sides shorter than k are
    mirrored as often as it takes. A line with a missing pixel is an error: filters count on neighbours.
    """
    line = Window.partitionBy(*keys, "x" if axis == "y" else "y")
    px = px.withColumns({"_first": F.min(axis).over(line), "_last": F.max(axis).over(line), "_there": F.count(F.lit(1)).over(line)})
    gap = F.raise_error(F.concat(F.lit(f"a filter along {axis} needs whole lines; places there: "), F.col("_there").cast("string"), F.lit(", last: "), F.col("_last").cast("string")))
    px = px.withColumn("_last", F.when(F.col("_there") == F.col("_last") - F.col("_first") + 1, F.col("_last")).otherwise(gap.cast("int"))).drop("_there")
    if border == "valid":
        return px
    a, first, last, off = F.col(axis), F.col("_first"), F.col("_last"), 0 if border == "mirror" else 1
    low, high = 2 * first - a - off, 2 * last - a + off
    once = F.array_compact(F.array(a, F.when((low < first) & (low >= first - k), low), F.when((high > last) & (high <= last + k), high)))
    period = 2 * (last - first) + 2 * off

    def mirrored(p: Column) -> Column:
        at = F.pmod(p - first, F.greatest(period, F.lit(1)))
        return first + F.least(at, period - off - at)

    often = F.filter(F.sequence(first - k, last + k), lambda p: mirrored(p) == a)
    return px.withColumn(axis, F.explode(F.when(last - first >= k, once).otherwise(often)))


def beside(c: str, axis: str, d: int, w: Window) -> Column:
    """The value d places along the axis; null where that pixel is missing."""
    shift = F.lead if d > 0 else F.lag
    return F.when(shift(axis, abs(d)).over(w) == F.col(axis) + d, shift(c, abs(d)).over(w))


def weighted_sum(terms: list[tuple[float, str, str]]) -> Column:
    """The sum of weight * struct.field, as one SQL text: long sums are quicker to build this way."""
    return F.expr(" + ".join(["0.0D", *[f"{weight!r}D * `{struct}`.`{field}`" for weight, struct, field in terms]]))


def tap_filter(px: DataFrame, columns: list[str], taps: dict[int, float], axis: str, border: str = "mirror", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """px with each column replaced by its weighted sum along an axis; with "valid" only places whose taps all exist."""
    k = max(abs(d) for d in taps)
    px = _padded(px, axis, k, border, keys)
    w = Window.partitionBy(*keys, "x" if axis == "y" else "y").orderBy(axis)
    # one struct of all columns is looked up beside, so a tap costs one window expression
    beside_it = {d: (F.lead if d > 0 else F.lag)("_tap", abs(d)).over(w) for d in taps if d}
    px = px.withColumn("_tap", F.struct(*columns)).withColumns({f"_tap{d}": v for d, v in beside_it.items()})
    total = lambda c: weighted_sum([(weight, f"_tap{d}" if d else "_tap", c) for d, weight in taps.items()])
    margin = k if border == "valid" else 0
    px = px.where((F.col(axis) >= F.col("_first") + margin) & (F.col(axis) <= F.col("_last") - margin))
    return px.withColumns({c: total(c) for c in columns}).drop("_first", "_last", "_tap", *[f"_tap{d}" for d in beside_it])


def separable(px: DataFrame, columns: list[str], taps: dict[int, float], border: str = "mirror", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Both axes, one after the other."""
    return tap_filter(tap_filter(px, columns, taps, "x", border, keys), columns, taps, "y", border, keys)


def sobel(px: DataFrame, columns: list[str], fast: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """px with <column>_g and <column>_a, strength and orientation (N14: edges repeated, atan; N15, fast: mirrored, atan2)."""
    windows = {"x": Window.partitionBy(*keys, "y").orderBy("x"), "y": Window.partitionBy(*keys, "x").orderBy("y")}

    def sides(px: DataFrame, names: dict[str, str], axis: str, ends: str) -> DataFrame:
        """px with <name><end> of both neighbours for each column -> name; past the border the mirrored (fast) or the repeated one."""
        px = px.withColumn("_here", F.struct(*names)).withColumns({f"_{d}": beside("_here", axis, d, windows[axis]) for d in (-1, 1)})
        past = lambda c, d: F.col(f"_{-d}")[c] if fast else F.col(c)
        found = {name + end: F.coalesce(F.col(f"_{d}")[c], past(c, d)) for c, name in names.items() for d, end in zip((-1, 1), ends)}
        return px.withColumns(found).drop("_here", "_-1", "_1")

    px = sides(px, {c: f"_{c}_" for c in columns}, "x", "lr")
    px = px.withColumns({f"_{c}_d": F.col(f"_{c}_r") - F.col(f"_{c}_l") for c in columns} | {f"_{c}_s": F.col(f"_{c}_l") + 2 * F.col(c) + F.col(f"_{c}_r") for c in columns})
    px = sides(px.drop(*[f"_{c}_{e}" for c in columns for e in "lr"]), {f"_{c}_{k}": f"_{c}_{k}" for c in columns for k in "ds"}, "y", "ud")
    out = {}
    for c in columns:
        gx = F.col(f"_{c}_du") + 2 * F.col(f"_{c}_d") + F.col(f"_{c}_dd")
        gy = F.col(f"_{c}_sd") - F.col(f"_{c}_su")
        out[f"{c}_g"] = F.sqrt(gx * gx + gy * gy)
        out[f"{c}_a"] = F.atan2(gy, gx + 1e-12) if fast else F.when(gx == 0, F.lit(math.pi / 2)).otherwise(F.atan(gy / -gx))
    px = px.withColumns(out)
    return px.drop(*[f"_{c}_{k}{end}" for c in columns for k in "ds" for end in ("", "u", "d")])


def central_gradient(px: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """px with <column>_gx and <column>_gy: half the difference of the neighbours, one-sided at the border."""
    out = {}
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        for c in columns:
            before, after = beside(c, axis, -1, w), beside(c, axis, 1, w)
            out[f"{c}_g{axis}"] = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2.0)
    return px.withColumns(out)


def gradient_feature(px: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """px with <column>_e: gradient strength scaled to [0, 1] within an image."""
    px = central_gradient(px, columns, keys)
    px = px.withColumns({f"{c}_e": F.sqrt(F.col(f"{c}_gx") * F.col(f"{c}_gx") + F.col(f"{c}_gy") * F.col(f"{c}_gy")) for c in columns})
    span = px.groupBy(*keys).agg(*[f(f"{c}_e").alias(f"_{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    px = px.join(span, list(keys)).withColumns({f"{c}_e": (F.col(f"{c}_e") - F.col(f"_{c}_lo")) / (F.col(f"_{c}_hi") - F.col(f"_{c}_lo") + 1e-12) for c in columns})
    return px.drop(*[f"{c}_g{a}" for c in columns for a in "xy"], *[f"_{c}_{n}" for c in columns for n in ("lo", "hi")])


def box_mean(px: DataFrame, columns: list[str], n: int = 7, border: str = "symmetric", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean over n x n; "valid" keeps the interior only."""
    return separable(px, columns, box_taps(n), border, keys)


def aligned(frames: list[tuple[DataFrame, list[str]]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, y, x and the columns of each relation at the places that all have; each place once in each.

    An inner join by place as a union and a grouped maximum: rows that are dealt by the keys stay where they are, where a
    join would deal both sides anew by place.
    """
    place = [*keys, "y", "x"]
    every = {c: df.schema[c].dataType for df, columns in frames for c in columns}
    parts = [df.select(*place, *[F.col(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in every.items()]) for df, own in frames]
    grouped = reduce(DataFrame.unionByName, parts).groupBy(*place).agg(*[F.max(c).alias(c) for c in every], F.count(F.lit(1)).alias("_n"))
    return grouped.where(F.col("_n") == len(frames)).drop("_n")


def pyr_down(px: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Blur and keep even places."""
    px = separable(px, columns, PYRAMID_TAPS, "mirror", keys).where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    return px.withColumns({"x": (F.col("x") / 2).cast("int"), "y": (F.col("y") / 2).cast("int")})


def pyr_up(small: DataFrame, grid: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """small blown up to the places of grid (keys, y, x): even places 1/8, 6/8, 1/8 of three, odd places half of two neighbours.

    Past the end the last value counts, before the start the mirrored one, as doubling with inserted zeros and a mirrored border gives.
    """
    return aligned([(grid, []), (_doubled(small, columns, keys), columns)], keys)


def _doubled(small: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    out = small
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        out = out.withColumns({f"_{c}_{n}": v for c in columns for n, v in (("b", F.lag(c).over(w)), ("a", F.lead(c).over(w)))})
        both = []
        for odd in (0, 1):
            values = {}
            for c in columns:
                here, before, after = F.col(c), F.col(f"_{c}_b"), F.col(f"_{c}_a")
                right = F.coalesce(after, here)
                values[c] = 0.5 * here + 0.5 * right if odd else 0.125 * F.coalesce(before, after, here) + 0.75 * here + 0.125 * right
            both.append(F.struct((2 * F.col(axis) + odd).cast("int").alias(axis), *[v.alias(c) for c, v in values.items()]))
        out = out.select(*keys, other, F.explode(F.array(*both)).alias("_p")).select(*keys, other, f"_p.{axis}", *[f"_p.{c}" for c in columns])
    return out


def with_up(fine: DataFrame, small: DataFrame, keep: list[str], columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, y, x, the columns keep of fine, and of small blown up to fine's places as _<column>_up."""
    up = _doubled(small, columns, keys).withColumnsRenamed({c: f"_{c}_up" for c in columns})
    return aligned([(fine, keep), (up, [f"_{c}_up" for c in columns])], keys)


def gaussian_pyramid(px: DataFrame, columns: list[str], levels: int, keys: tuple[str, ...] = KEYS, cut: Callable[[DataFrame], DataFrame] = lambda level: level) -> list[DataFrame]:
    """cut is applied to every level but the first: with ``staged`` a level starts from the written one before it."""
    out = [px.select(*keys, "y", "x", *columns)]
    for _ in range(levels - 1):
        out.append(cut(pyr_down(out[-1], columns, keys)))
    return out


def laplacian_level(fine: DataFrame, coarse: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    both = with_up(fine, coarse, columns, columns, keys)
    return both.select(*keys, "y", "x", *[(F.col(c) - F.col(f"_{c}_up")).alias(c) for c in columns])


def laplacian_pyramid(px: DataFrame, columns: list[str], levels: int, keys: tuple[str, ...] = KEYS) -> list[DataFrame]:
    """Each level less the next one blown up; the last one as it is."""
    g = gaussian_pyramid(px, columns, levels, keys)
    return [*[laplacian_level(fine, coarse, columns, keys) for fine, coarse in zip(g, g[1:])], g[-1]]


def reconstruct(pyramid: list[DataFrame], columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The image of a Laplacian pyramid."""
    out = pyramid[-1]
    for fine in reversed(pyramid[:-1]):
        both = with_up(fine, out, columns, columns, keys)
        out = both.select(*keys, "y", "x", *[(F.col(c) + F.col(f"_{c}_up")).alias(c) for c in columns])
    return out


def haar_split(px: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, band (A, H, V, D), y, x, columns: one level of the Haar transform over 2 x 2 cells; odd sides repeat their edge."""
    cell = [*keys, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")]
    at = lambda c, dy, dx: F.max(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col(c)))
    quad = px.groupBy(*cell).agg(*[at(c, dy, dx).alias(f"_{c}_{dy}{dx}") for c in columns for dy in (0, 1) for dx in (0, 1)])
    bands = []
    signs = {"A": (1, 1, 1, 1), "H": (1, 1, -1, -1), "V": (1, -1, 1, -1), "D": (1, -1, -1, 1)}
    for band, (s0, s1, s2, s3) in signs.items():
        values = []
        for c in columns:
            a = F.col(f"_{c}_00")
            b, d = F.coalesce(f"_{c}_01", a), F.coalesce(f"_{c}_10", a)
            e = F.coalesce(F.col(f"_{c}_11"), F.when(F.col(f"_{c}_10").isNull(), b).otherwise(d))
            values.append(((s0 * a + s1 * b + s2 * d + s3 * e) / 2.0).alias(c))
        bands.append(F.struct(F.lit(band).alias("band"), *values))
    return quad.select(*keys, "y", "x", F.explode(F.array(*bands)).alias("_b")).select(*keys, "_b.band", "y", "x", *[f"_b.{c}" for c in columns])


def haar_join(bands: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The inverse of haar_split; cells past an odd side are the caller's to drop."""
    of = lambda c, band: F.max(F.when(F.col("band") == band, F.col(c)))
    cells = bands.groupBy(*keys, "y", "x").agg(*[of(c, band).alias(f"_{c}_{band}") for c in columns for band in "AHVD"])
    out = []
    for dy in (0, 1):
        for dx in (0, 1):
            sh, sv = 1 - 2 * dy, 1 - 2 * dx
            values = [((F.col(f"_{c}_A") + sh * F.col(f"_{c}_H") + sv * F.col(f"_{c}_V") + sh * sv * F.col(f"_{c}_D")) / 2.0).alias(c) for c in columns]
            out.append(F.struct((2 * F.col("y") + dy).alias("y"), (2 * F.col("x") + dx).alias("x"), *values))
    return cells.select(*keys, F.explode(F.array(*out)).alias("_p")).select(*keys, "_p.y", "_p.x", *[f"_p.{c}" for c in columns])


def resize(px: DataFrame, columns: list[str], sizes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """px at the places of sizes (keys, height, width) by bilinear interpolation with half-pixel centres."""
    old = px.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    grid = sizes.join(old, list(keys))
    for axis, new, was in (("y", "height", "_h"), ("x", "width", "_w")):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(new) - 1)))
        at = F.least(F.greatest((F.col(axis) + 0.5) * F.col(was) / F.col(new) - 0.5, F.lit(0.0)), (F.col(was) - 1).cast("double"))
        low = F.floor(at).cast("int")
        taps = F.array(F.struct(low.alias("p"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.col(was) - 1).alias("p"), (at - low).alias("w")))
        grid = grid.withColumn(f"_{axis}", F.explode(taps)).where(F.col(f"_{axis}.w") > 0)
    taps = grid.select(*keys, "y", "x", F.col("_y.p").alias("_py"), F.col("_x.p").alias("_px"), (F.col("_y.w") * F.col("_x.w")).alias("_weight"))
    source = px.select(*keys, F.col("y").alias("_py"), F.col("x").alias("_px"), *columns)
    return taps.join(source, [*keys, "_py", "_px"]).groupBy(*keys, "y", "x").agg(*[F.sum(F.col("_weight") * F.col(c)).alias(c) for c in columns])
