"""Queries of the pixel operators. The oracles use neighbour joins over explicit offsets, not windows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import clip01, rounded
from ..operators import filters, fusion, metrics, morphology, wavelets
from ..sources.staging import new_path, staged
from . import flows
from .fixtures import PX, RASTER, pixels, raster
from .registry import ORACLES, query

R, M = 2, 0.0703


def out(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("pair_id", "y", "x")) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(c)).alias(c) for c in columns])


def with_fused(px: DataFrame) -> DataFrame:
    """px with a plain f, so that metrics don't depend on a fusion method."""
    return px.withColumn("f", 0.7 * F.greatest("vis", "ir") + 0.3 * F.least("vis", "ir"))


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# --- SQL building blocks
FUSED = "fx AS (SELECT *, CAST(0.7 AS DOUBLE) * greatest(vis, ir) + CAST(0.3 AS DOUBLE) * least(vis, ir) AS f FROM px)"
POINTS = "pt AS (SELECT pair_id, y, x, 'vis' AS c, vis AS v FROM px UNION ALL SELECT pair_id, y, x, 'ir', ir FROM px)"


def offsets(r: int) -> str:
    """(shape, dy, dx): the disk and four lines of radius r."""
    k = math.floor(r * (1 + math.sqrt(0.5)) + 0.5) - r
    rows = [("disk", dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= math.floor(math.sqrt(r * r - dy * dy) + 0.5)]
    rows += [("0", 0, d) for d in range(-r, r + 1)] + [("90", d, 0) for d in range(-r, r + 1)]
    rows += [("45", -d, d) for d in range(-k, k + 1)] + [("135", d, d) for d in range(-k, k + 1)]
    return "o(shape, dy, dx) AS (VALUES " + ", ".join(str(row) for row in rows) + ")"


MORPH = """lo AS (SELECT a.pair_id, a.y, a.x, a.c, o.shape, min(b.v) AS lo, max(b.v) AS hi FROM pt a CROSS JOIN o
  JOIN pt b ON b.pair_id = a.pair_id AND b.c = a.c AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
oc AS (SELECT a.pair_id, a.y, a.x, a.c, a.shape, max(b.lo) AS op, min(b.hi) AS cl FROM lo a JOIN o ON o.shape = a.shape
  JOIN lo b ON b.shape = a.shape AND b.pair_id = a.pair_id AND b.c = a.c AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
hat AS (SELECT oc.*, v - op AS wth, cl - v AS bth FROM oc JOIN pt USING (pair_id, y, x, c)),
comb AS (SELECT pair_id, y, x, c, max(wth) FILTER (shape = 'disk') AS wd, max(bth) FILTER (shape = 'disk') AS bd,
  sum(wth) FILTER (shape <> 'disk') / 4 AS wl, sum(bth) FILTER (shape <> 'disk') / 4 AS bl FROM hat GROUP BY ALL)"""
MORPHED = f"WITH {PX}, {POINTS}, {offsets(R)}, {MORPH}"


def fused_sql(wth: str, bth: str, m: float) -> str:
    return f"""{MORPHED}, d AS (SELECT pair_id, y, x, max({wth}) AS w, max({bth}) AS b FROM comb GROUP BY ALL)
SELECT pair_id, y, x, {r6(f"least(greatest((vis + ir) * CAST(0.5 AS DOUBLE) + CAST({m} AS DOUBLE) * w - CAST({m} AS DOUBLE) * b, 0.0), 1.0)", "f")} FROM px JOIN d USING (pair_id, y, x)"""


def mirrored(q: str, last: str, kind: str) -> str:
    if kind == "mirror" and last.isdigit() and int(last) < 4:  # reflected more than once
        p = max(1, 2 * int(last))
        return f"least((({q}) % {p} + {p}) % {p}, {2 * int(last)} - (({q}) % {p} + {p}) % {p})"
    return {
        "mirror": f"CASE WHEN {q} < 0 THEN -({q}) WHEN {q} > {last} THEN 2 * {last} - ({q}) ELSE {q} END",
        "symmetric": f"CASE WHEN {q} < 0 THEN -({q}) - 1 WHEN {q} > {last} THEN 2 * {last} - ({q}) + 1 ELSE {q} END",
        "edge": f"least(greatest({q}, 0), {last})",
        "valid": q,
    }[kind]


def taps_sql(taps: dict[int, float], name: str = "t") -> str:
    return f"{name}(d, w) AS (SELECT CAST(d AS INT), CAST(w AS DOUBLE) FROM (VALUES " + ", ".join(f"({d}, {w!r})" for d, w in taps.items()) + ") q(d, w))"


def stencil_sql(source: str, columns: list[str], last: int, kind: str, to: str, taps: str = "t") -> str:
    """Weighted sums along x, then along y, by joins with the taps."""
    steps, was = [], source
    for axis, other, name in (("x", "y", f"{to}_x"), ("y", "x", to)):
        sums = ", ".join(f"sum({taps}.w * b.{c}) AS {c}" for c in columns)
        inner = f"WHERE a.{axis} BETWEEN -(SELECT min(d) FROM {taps}) AND {last} + (SELECT min(d) FROM {taps})" if kind == "valid" else ""
        places = f"(SELECT a.pair_id, a.y, a.x, {taps}.w, {mirrored(f'a.{axis} + {taps}.d', str(last), kind)} AS q FROM {was} a CROSS JOIN {taps} {inner}) {taps}"
        steps.append(f"""{name} AS (SELECT {taps}.pair_id, {taps}.y, {taps}.x, {sums} FROM {places}
  JOIN {was} b ON b.pair_id = {taps}.pair_id AND b.{other} = {taps}.{other} AND b.{axis} = {taps}.q GROUP BY ALL)""")
        was = name
    return ",\n".join(steps)


def sobel_sql(source: str, column: str, kind: str, to: str) -> str:
    at = lambda dy, dx: f"max(b.{column}) FILTER (o.dy = {dy} AND o.dx = {dx})"
    # equal sides must give exactly 0: the sign of a rounding error would turn the angle
    gx = f"(({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)}) - ({at(-1, -1)} + 2 * {at(0, -1)} + {at(1, -1)}))"
    gy = f"(({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)}) - ({at(-1, -1)} + 2 * {at(-1, 0)} + {at(-1, 1)}))"
    angle = "atan2(gy, gx + 1e-12)" if kind == "mirror" else "CASE WHEN gx = 0 THEN pi() / 2 ELSE atan(gy / -gx) END"
    return f"""{to}0 AS (SELECT a.pair_id, a.y, a.x, {gx} AS gx, {gy} AS gy FROM {source} a CROSS JOIN (SELECT dy.range - 1 AS dy, dx.range - 1 AS dx FROM range(3) dy, range(3) dx) o
  JOIN {source} b ON b.pair_id = a.pair_id AND b.y = {mirrored("a.y + o.dy", "7", kind)} AND b.x = {mirrored("a.x + o.dx", "7", kind)} GROUP BY a.pair_id, a.y, a.x),
{to} AS (SELECT pair_id, y, x, sqrt(gx * gx + gy * gy) AS g, {angle} AS a FROM {to}0)"""


def gradient_sql(source: str, columns: list[str], to: str) -> str:
    """Central differences by neighbour joins."""
    cols = ", ".join(f"(r.{c} - l.{c}) / (r.x - l.x) AS {c}_gx, (d.{c} - u.{c}) / (d.y - u.y) AS {c}_gy, a.{c}" for c in columns)
    return f"""{to} AS (SELECT a.pair_id, a.y, a.x, {cols} FROM {source} a
  JOIN {source} l ON l.pair_id = a.pair_id AND l.y = a.y AND l.x = greatest(a.x - 1, 0) JOIN {source} r ON r.pair_id = a.pair_id AND r.y = a.y AND r.x = least(a.x + 1, 7)
  JOIN {source} u ON u.pair_id = a.pair_id AND u.x = a.x AND u.y = greatest(a.y - 1, 0) JOIN {source} d ON d.pair_id = a.pair_id AND d.x = a.x AND d.y = least(a.y + 1, 7))"""


def feature_sql(columns: list[str], to: str) -> str:
    g = ", ".join(f"sqrt({c}_gx * {c}_gx + {c}_gy * {c}_gy) AS {c}" for c in columns)
    w = "OVER (PARTITION BY pair_id)"
    return f"""{to}0 AS (SELECT pair_id, y, x, {g} FROM gr), {to} AS (SELECT pair_id, y, x, {", ".join(f"({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w} + 1e-12) AS {c}" for c in columns)} FROM {to}0)"""


# --- sources and projections
@query("s02_p02_j08_pair_load", f"WITH {PX} SELECT pair_id, y, x, {r6('vis', 'vis')}, {r6('ir', 'ir')} FROM px")
def pair_load(spark, sf_dir):
    """Two image scans joined by place."""
    px = pixels(spark, sf_dir)
    vis, ir = px.select("pair_id", "y", "x", "vis"), px.select("pair_id", "y", "x", "ir")
    return out(vis.join(ir, ["pair_id", "y", "x"]), "vis", "ir")


@query("s08_p01_quantise", f"""WITH {PX} SELECT pair_id, y, x, CAST(floor(least(greatest(vis * 1.2 - 0.1, 0.0), 1.0) * 255) AS INT) AS v8,
  {r6("floor(least(greatest(vis * 1.2 - 0.1, 0.0), 1.0) * 255) / CAST(255 AS DOUBLE)", "back")} FROM px""")  # fmt: skip
def quantise(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("v8", scalar.to_byte(F.col("vis") * 1.2 - 0.1))
    return px.select("pair_id", "y", "x", "v8", rounded(scalar.from_byte(F.col("v8"))).alias("back"))


@query("p03_resize", f"""WITH {PX}, g AS (SELECT y.range AS y, x.range AS x, least(greatest((y.range + 0.5) * 8 / CAST(5 AS DOUBLE) - 0.5, 0), 7) AS fy,
  least(greatest((x.range + 0.5) * 8 / CAST(12 AS DOUBLE) - 0.5, 0), 7) AS fx FROM range(5) y, range(12) x)
SELECT pair_id, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, {r6("sum(ir * greatest(0, 1 - abs(px.y - fy)) * greatest(0, 1 - abs(px.x - fx)))", "ir")}
FROM g JOIN px ON abs(px.y - fy) < 1 AND abs(px.x - fx) < 1 GROUP BY pair_id, g.y, g.x""")
def resize(spark, sf_dir):
    px = pixels(spark, sf_dir)
    sizes = px.select("pair_id").distinct().withColumns({"height": F.lit(5), "width": F.lit(12)})
    return out(filters.resize(px, ["ir"], sizes), "ir")


@query("p08_p09_scene_picks", f"""WITH {PX}, n AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS rn FROM (SELECT DISTINCT pair_id FROM px))
SELECT pair_id, rn, (rn - 1) % 7 = 0 AS sampled, rn IN (2, 8, 17) AS picked FROM n WHERE (rn - 1) % 7 = 0 OR rn IN (2, 8, 17)""")
def scene_picks(spark, sf_dir):
    n = flows.numbered_pairs(pixels(spark, sf_dir).select("pair_id").distinct())
    n = n.withColumns({"sampled": (F.col("rn") - 1) % 7 == 0, "picked": F.col("rn").isin(2, 8, 17)})
    return n.where("sampled OR picked")


# --- morphology
@query("n01_n04_disk_filters", f"{MORPHED} SELECT pair_id, y, x, {r6('lo', 'lo')}, {r6('hi', 'hi')} FROM lo WHERE c = 'vis' AND shape = 'disk'")
def disk_filters(spark, sf_dir):
    return out(morphology.disk_filter(pixels(spark, sf_dir), {"lo": ("min", "vis"), "hi": ("max", "vis")}, R), "lo", "hi")


@query("n02_n03_line_filters", f"{MORPHED} SELECT pair_id, y, x, CAST(shape AS INT) AS direction, {r6('lo', 'lo')}, {r6('hi', 'hi')} FROM lo WHERE c = 'vis' AND shape <> 'disk'")
def line_filters(spark, sf_dir):
    px = pixels(spark, sf_dir)
    for d in morphology.DIRECTIONS:
        px = morphology.line_filter(px, {f"lo{d}": ("min", "vis"), f"hi{d}": ("max", "vis")}, morphology.line_half_length(R, d), d)
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"lo{d}").alias("lo"), F.col(f"hi{d}").alias("hi")) for d in morphology.DIRECTIONS]))
    return out(px.select("pair_id", "y", "x", rows.alias("r")).select("pair_id", "y", "x", "r.*"), "lo", "hi", keys=("pair_id", "y", "x", "direction"))


@query("n05_open_close", f"{MORPHED} SELECT pair_id, y, x, {r6('op', 'vis_open')}, {r6('cl', 'vis_close')} FROM oc WHERE c = 'vis' AND shape = '45'")
def open_close(spark, sf_dir):
    return out(morphology.open_close(pixels(spark, sf_dir), ["vis"], 45, R), "vis_open", "vis_close")


@query("n06_top_hats", f"{MORPHED} SELECT pair_id, y, x, {r6('wth', 'vis_wth')}, {r6('bth', 'vis_bth')} FROM hat WHERE c = 'vis' AND shape = 'disk'")
def top_hats(spark, sf_dir):
    return out(morphology.top_hats(pixels(spark, sf_dir), ["vis"], "disk", R), "vis_wth", "vis_bth")


def spread_sql(r: int, source: str, lo: str, hi: str, to: str, last: int = 63) -> str:
    """to(pair_id, y, x, c, shape, lo, hi): least lo and largest hi of source over the disk and the lines of radius r, each row by a frame. Every step is worked out once."""
    rows = morphology.disk_rows(r)
    frames = [
        f"SELECT pair_id, y, x, c, {h} AS h, min({lo}) OVER w AS lo, max({hi}) OVER w AS hi FROM {source} WHERE shape = 'disk' WINDOW w AS (PARTITION BY pair_id, c, y ORDER BY x RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        for h in sorted(set(rows.values()))
    ]
    lines = []
    for d in morphology.DIRECTIONS:
        k, across, along = morphology.line_half_length(r, d), {0: "y", 90: "x", 45: "x + y", 135: "x - y"}[d], "y" if d == 90 else "x"
        lines.append(f"SELECT pair_id, y, x, c, shape, min({lo}) OVER w AS lo, max({hi}) OVER w AS hi FROM {source} WHERE shape = '{d}' WINDOW w AS (PARTITION BY pair_id, c, {across} ORDER BY {along} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)")
    offsets = ", ".join(f"({dy}, {h})" for dy, h in rows.items())
    return f"""{to}f AS MATERIALIZED ({" UNION ALL ".join(frames)}), {to}o(dy, h) AS (VALUES {offsets}),
{to} AS MATERIALIZED (SELECT f.pair_id, f.y - o.dy AS y, f.x, f.c, 'disk' AS shape, min(f.lo) AS lo, max(f.hi) AS hi FROM {to}f f JOIN {to}o o USING (h) WHERE f.y - o.dy BETWEEN 0 AND {last} GROUP BY ALL
  UNION ALL {" UNION ALL ".join(lines)})"""


def _both(hat: str) -> str:
    of = lambda shape: f"max({hat}) FILTER (shape = '{shape}')"
    return f"{of('disk')} + ({' + '.join(of(d) for d in morphology.DIRECTIONS)}) / 4"


WIDE_R = 25
SHAPES = "('disk'), " + ", ".join(f"('{d}')" for d in morphology.DIRECTIONS)


def hats_sql(px: str, r: int, last: int) -> str:
    """CTEs up to comb(pair_id, y, x, c, w, b, wd, bd): combined top-hats and those of the disk, of the pairs that the CTEs px give."""
    return f"""{px}, pt AS MATERIALIZED (SELECT pair_id, y, x, 'vis' AS c, shape, vis AS v FROM px, (VALUES {SHAPES}) s(shape) UNION ALL SELECT pair_id, y, x, 'ir', shape, ir FROM px, (VALUES {SHAPES}) s(shape)),
{spread_sql(r, "pt", "v", "v", "e1", last)}, {spread_sql(r, "e1", "hi", "lo", "e2", last)},
hat AS (SELECT pt.pair_id, pt.y, pt.x, pt.c, pt.shape, v - e2.hi AS wth, e2.lo - v AS bth FROM pt JOIN e2 USING (pair_id, y, x, c, shape)),
comb AS (SELECT pair_id, y, x, c, {_both('wth')} AS w, {_both('bth')} AS b, max(wth) FILTER (shape = 'disk') AS wd, max(bth) FILTER (shape = 'disk') AS bd FROM hat GROUP BY ALL)"""


def top_hat_sql(px: str, r: int, last: int, m: float, w: str = "w", b: str = "b", digits: int = 6) -> str:
    return f"""WITH {hats_sql(px, r, last)}, top AS (SELECT pair_id, y, x, max({w}) AS w, max({b}) AS b FROM comb GROUP BY ALL)
SELECT pair_id, y, x, round(least(greatest((vis + ir) * CAST(0.5 AS DOUBLE) + CAST({m} AS DOUBLE) * w - CAST({m} AS DOUBLE) * b, 0.0), 1.0), {digits}) + 0.0 AS f FROM px JOIN top USING (pair_id, y, x)"""


WIDE = f"WITH {hats_sql(RASTER, WIDE_R, 63)}"


@query("n04_wide_disk", f"{WIDE} SELECT pair_id, y, x, {r6('lo', 'lo')}, {r6('hi', 'hi')} FROM e1 WHERE c = 'vis' AND shape = 'disk'")
def wide_disk(spark, sf_dir):
    """Disk filters at the published radius, on 64 x 64 pairs."""
    return out(morphology.disk_filter(raster(spark, sf_dir), {"lo": ("min", "vis"), "hi": ("max", "vis")}, WIDE_R), "lo", "hi")


@query("f07_weighted_top_hat_published", top_hat_sql(RASTER, WIDE_R, 63, M, digits=10))
def weighted_top_hat_published(spark, sf_dir):
    """The proposal at its published r and m, on 64 x 64 pairs. Ten digits: all values that are short decimals have no more, so none is a tie."""
    return fusion.weighted_top_hat(raster(spark, sf_dir), WIDE_R, M).select("pair_id", "y", "x", rounded(F.col("f"), 10).alias("f"))


@query("f07_weighted_top_hat_tiled", top_hat_sql(RASTER, 5, 63, M, digits=10))
def weighted_top_hat_tiled(spark, sf_dir):
    """Each 64 x 64 pair in sixteen tiles with halos of ten places."""
    return fusion.weighted_top_hat(raster(spark, sf_dir), 5, M, tile=16).select("pair_id", "y", "x", rounded(F.col("f"), 10).alias("f"))


for _mode, _w, _b in (("sum", "wd + wl", "bd + bl"), ("avg", "(wd + wl) / 2", "(bd + bl) / 2"), ("max", "greatest(wd, wl)", "greatest(bd, bl)")):

    @query(f"n07_combined_{_mode}", f"{MORPHED} SELECT pair_id, y, x, {r6(_w, 'ir_wth')}, {r6(_b, 'ir_bth')} FROM comb WHERE c = 'ir'")
    def combined(spark, sf_dir, mode=_mode):
        return out(morphology.combined_top_hats(pixels(spark, sf_dir), ["ir"], R, mode), "ir_wth", "ir_bth")


# --- filters
@query("n08_pyr_down", f"WITH {PX}, {taps_sql(filters.PYRAMID_TAPS)}, {stencil_sql('px', ['vis'], 7, 'mirror', 's')} SELECT pair_id, y // 2 AS y, x // 2 AS x, {r6('vis', 'vis')} FROM s WHERE y % 2 = 0 AND x % 2 = 0")
def pyr_down(spark, sf_dir):
    return out(filters.pyr_down(pixels(spark, sf_dir), ["vis"]), "vis")


def up_sql(small: str, to: str, last: int, column: str = "vis") -> str:
    """Doubling with inserted zeros (an odd place has no value), a mirrored border, and four times the taps."""
    return f"""{to} AS (SELECT s.pair_id, CAST(gy.range AS INT) AS y, CAST(gx.range AS INT) AS x, sum(4 * ty.w * tx.w * s.{column}) AS {column} FROM range({last + 1}) gy CROSS JOIN range({last + 1}) gx CROSS JOIN t ty CROSS JOIN t tx
  JOIN {small} s ON 2 * s.y = {mirrored("gy.range + ty.d", str(last), "mirror")} AND 2 * s.x = {mirrored("gx.range + tx.d", str(last), "mirror")} GROUP BY s.pair_id, gy.range, gx.range)"""


DOWN = f"WITH {PX}, {taps_sql(filters.PYRAMID_TAPS)}, {stencil_sql('px', ['vis', 'ir'], 7, 'mirror', 's')}, lv AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, vis, ir FROM s WHERE y % 2 = 0 AND x % 2 = 0)"


@query("n09_n10_laplacian_level", f"{DOWN}, {up_sql('lv', 'u', 7)} SELECT px.pair_id, px.y, px.x, {r6('px.vis - u.vis', 'vis')} FROM px JOIN u USING (pair_id, y, x)")
def laplacian_level(spark, sf_dir):
    return out(filters.laplacian_pyramid(pixels(spark, sf_dir), ["vis"], 2)[0], "vis")


@query("n11_reconstruct", f"WITH {PX} SELECT pair_id, y, x, {r6('vis', 'vis')} FROM px")
def reconstruct(spark, sf_dir):
    return out(filters.reconstruct(filters.laplacian_pyramid(pixels(spark, sf_dir), ["vis"], 3), ["vis"]), "vis")


@query("n12_n13_activity", f"WITH {PX}, {taps_sql(filters.PYRAMID_TAPS)}, ab AS (SELECT pair_id, y, x, abs(vis - 0.5) AS vis FROM px), {stencil_sql('ab', ['vis'], 7, 'mirror', 's')} SELECT pair_id, y, x, {r6('vis', 'act')} FROM s")
def activity(spark, sf_dir):
    return out(filters.separable(pixels(spark, sf_dir).withColumn("act", F.abs(F.col("vis") - 0.5)), ["act"], filters.PYRAMID_TAPS), "act")


for _name, _fast, _kind in (("n14_sobel", False, "edge"), ("n15_sobel_fast", True, "mirror")):

    @query(_name, f"WITH {PX}, {sobel_sql('px', 'vis', _kind, 's')} SELECT pair_id, y, x, {r6('g', 'vis_g')}, {r6('a', 'vis_a')} FROM s")
    def sobel(spark, sf_dir, fast=_fast):
        return out(filters.sobel(pixels(spark, sf_dir), ["vis"], fast), "vis_g", "vis_a")


@query("n16_central_gradient", f"WITH {PX}, {gradient_sql('px', ['vis'], 'gr')} SELECT pair_id, y, x, {r6('vis_gx', 'vis_gx')}, {r6('vis_gy', 'vis_gy')} FROM gr")
def central_gradient(spark, sf_dir):
    return out(filters.central_gradient(pixels(spark, sf_dir), ["vis"]), "vis_gx", "vis_gy")


@query("n17_gradient_feature", f"WITH {PX}, {gradient_sql('px', ['vis'], 'gr')}, {feature_sql(['vis'], 'e1')} SELECT pair_id, y, x, {r6('vis', 'vis_e')} FROM e1")
def gradient_feature(spark, sf_dir):
    return out(filters.gradient_feature(pixels(spark, sf_dir), ["vis"]), "vis_e")


CELLS = "q AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, sum(vis * CASE WHEN y % 2 = 0 THEN 1 ELSE -1 END) AS h, sum(vis * CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END) AS v, sum(vis * CASE WHEN (x + y) % 2 = 0 THEN 1 ELSE -1 END) AS d, sum(vis) AS a FROM px GROUP BY 1, 2, 3)"


@query("n18_haar_split", f"WITH {PX}, {CELLS} SELECT pair_id, y, x, band, {r6('value / 2', 'vis')} FROM (UNPIVOT q ON a AS 'A', h AS 'H', v AS 'V', d AS 'D' INTO NAME band VALUE value)")
def haar_split(spark, sf_dir):
    return out(filters.haar_split(pixels(spark, sf_dir), ["vis"]), "vis", keys=("pair_id", "y", "x", "band"))


@query("n18_haar_round_trip", f"WITH {PX} SELECT pair_id, y, x, {r6('ir', 'ir')} FROM px")
def haar_round_trip(spark, sf_dir):
    return out(filters.haar_join(filters.haar_split(pixels(spark, sf_dir), ["ir"]), ["ir"]), "ir")


@query("n19_db4_round_trip", f"WITH {PX} SELECT pair_id, y, x, {r6('vis', 'vis')} FROM px")
def db4_round_trip(spark, sf_dir):
    return out(wavelets.join(wavelets.split(pixels(spark, sf_dir), ["vis"]), ["vis"]).where("y < 8 AND x < 8"), "vis")


def wavelet_sql(low_x: tuple[float, ...], low_y: tuple[float, ...], source: str = "px", column: str = "vis", last: int = 7) -> str:
    """CTEs up to co(pair_id, y, x, LL, LH, HL, HH): one level by joins with the taps over the border mirrored with its edge."""
    high = lambda low: [(-1) ** (len(low) - j) * low[len(low) - 1 - j] for j in range(len(low))]
    rows = lambda low: ", ".join(f"({j - len(low) + 1}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for j, (a, b) in enumerate(zip(low, high(low))))
    n = (last + len(low_x)) // 2
    at = lambda t: mirrored(f"2 * i.range + 1 + {t}.d", str(last), "symmetric")
    return f"""wx(d, l, h) AS (VALUES {rows(low_x)}), wy(d, l, h) AS (VALUES {rows(low_y)}),
along AS (SELECT b.pair_id, b.y, i.range AS x, sum(l * b.{column}) AS l, sum(h * b.{column}) AS h FROM range({n}) i CROSS JOIN wx JOIN {source} b ON b.x = {at("wx")} GROUP BY ALL),
co AS (SELECT b.pair_id, i.range AS y, b.x, sum(wy.l * b.l) AS LL, sum(wy.h * b.l) AS LH, sum(wy.l * b.h) AS HL, sum(wy.h * b.h) AS HH FROM range({n}) i CROSS JOIN wy JOIN along b ON b.y = {at("wy")} GROUP BY ALL)"""


for _name, _taps in (("n19_db4_coefficients", (wavelets.DB4, wavelets.DB4)), ("n20_first_level_coefficients", (wavelets.FIRST_A, wavelets.FIRST_B)), ("n20_quarter_shift_coefficients", (wavelets.QUARTER_B, wavelets.QUARTER_A))):

    @query(_name, f"WITH {PX}, {wavelet_sql(*_taps)} SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(r6(b, f"vis_{b}") for b in wavelets.BANDS) + " FROM co")
    def coefficients(spark, sf_dir, taps=_taps):
        return out(wavelets.split(pixels(spark, sf_dir), ["vis"], *taps), *[f"vis_{b}" for b in wavelets.BANDS])


def taps_rows(low: tuple[float, ...]) -> str:
    """(j, l, h) of a bank's synthesis taps."""
    n = len(low)
    return "VALUES " + ", ".join(f"({j}, CAST({low[j]!r} AS DOUBLE), CAST({(-1) ** (n - j) * low[n - 1 - j]!r} AS DOUBLE))" for j in range(n))


def analysis_sql(to: str, source: str, columns: dict[str, str], low_x: tuple[float, ...], low_y: tuple[float, ...], last: int) -> tuple[str, int]:
    """CTEs up to to(pair_id, y, x, <c>_LL, <c>_LH, <c>_HL, <c>_HH) of the source's columns (c -> column), and its last place."""
    n = (last + len(low_x)) // 2
    at = lambda size: mirrored(f"2 * i.range + 2 - {size} + w.j", str(last), "symmetric")
    along = ", ".join(f"sum(w.{k} * s.{column}) AS {c}_{k}" for c, column in columns.items() for k in "lh")
    bands = ", ".join(f"sum(w.{k} * s.{c}_{h}) AS {c}_{(h + k).upper()}" for c in columns for h in "lh" for k in "lh")
    return f"""{to}x AS MATERIALIZED (SELECT s.pair_id, s.y, i.range AS x, {along} FROM range({n}) i CROSS JOIN ({taps_rows(low_x)}) w(j, l, h) JOIN {source} s ON s.x = {at(len(low_x))} GROUP BY ALL),
{to} AS MATERIALIZED (SELECT s.pair_id, i.range AS y, s.x, {bands} FROM range({n}) i CROSS JOIN ({taps_rows(low_y)}) w(j, l, h) JOIN {to}x s ON s.y = {at(len(low_y))} GROUP BY ALL)""", n - 1


def synthesis_sql(to: str, source: str, low_x: tuple[float, ...], low_y: tuple[float, ...], last: int) -> str:
    """CTEs up to to(pair_id, y, x, f) of bands LL, LH, HL, HH: each coefficient spreads over as many places as there are taps."""
    to_y, to_x = (f"2 * (s.{axis} - {len(low) // 2 - 1}) + w.j" for axis, low in (("y", low_y), ("x", low_x)))
    return f"""{to}y AS MATERIALIZED (SELECT s.pair_id, {to_y} AS y, s.x, sum(w.l * s.LL + w.h * s.LH) AS l, sum(w.l * s.HL + w.h * s.HH) AS h FROM {source} s CROSS JOIN ({taps_rows(low_y)}) w(j, l, h) WHERE {to_y} BETWEEN 0 AND {last} GROUP BY ALL),
{to} AS MATERIALIZED (SELECT s.pair_id, s.y, {to_x} AS x, sum(w.l * s.l + w.h * s.h) AS f FROM {to}y s CROSS JOIN ({taps_rows(low_x)}) w(j, l, h) WHERE {to_x} BETWEEN 0 AND {last} GROUP BY ALL)"""


def db4_sql(levels: int) -> str:
    parts, lasts, was, both = [f"WITH {PX}"], [7], "px", {"vis": "vis", "ir": "ir"}
    for k in range(levels):
        text, last = analysis_sql(f"w{k}", was, both, wavelets.DB4, wavelets.DB4, lasts[-1])
        parts, lasts, was, both = [*parts, text], [*lasts, last], f"w{k}", {"vis": "vis_LL", "ir": "ir_LL"}
    parts.append(f"r{levels} AS (SELECT pair_id, y, x, (vis_LL + ir_LL) / 2 AS f FROM {was})")
    for k in range(levels - 1, -1, -1):
        pick = ", ".join(f"CASE WHEN abs(vis_{b}) >= abs(ir_{b}) THEN vis_{b} ELSE ir_{b} END AS {b}" for b in wavelets.BANDS[1:])
        parts.append(f"d{k} AS (SELECT pair_id, y, x, f AS LL, {pick} FROM w{k} JOIN r{k + 1} USING (pair_id, y, x))")
        parts.append(synthesis_sql(f"r{k}", f"d{k}", wavelets.DB4, wavelets.DB4, lasts[k]))
    return ", ".join(parts) + f" SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r6('least(greatest(f, 0.0), 1.0)', 'f')} FROM r0"


def tree_levels(levels: int, px: str = PX) -> tuple[list[str], list[int]]:
    """CTEs t<k>_<tree> with vis_<band> and ir_<band> of each level, and the last place of each."""
    parts, lasts = [f"WITH {px}"], [7]
    for k in range(levels):
        low = dict(zip("ab", (wavelets.QUARTER_A, wavelets.QUARTER_B) if k else (wavelets.FIRST_A, wavelets.FIRST_B)))
        for t in wavelets.TREES:
            text, last = analysis_sql(f"t{k}_{t}", f"t{k - 1}_{t}" if k else "px", {c: f"{c}_LL" if k else c for c in ("vis", "ir")}, low[t[0]], low[t[1]], lasts[k])
            parts.append(text)
        lasts.append(last)
    return parts, lasts


def dual_tree_sql(levels: int) -> str:
    parts, lasts = tree_levels(levels)
    parts += [f"r{levels}_{t} AS (SELECT pair_id, y, x, (vis_LL + ir_LL) / 2 AS f FROM t{levels - 1}_{t})" for t in wavelets.TREES]
    for k in range(levels - 1, -1, -1):
        names = lambda c, b: {t: f"{t}.{c}_{b}" for t in wavelets.TREES}
        z, picks, mixed = [], [], {t: [] for t in wavelets.TREES}
        for b in wavelets.BANDS[1:]:
            for c in ("vis", "ir"):
                v = names(c, b)
                z += [f"{v['aa']} - {v['bb']} AS {c}_{b}_r1, {v['ab']} + {v['ba']} AS {c}_{b}_i1, {v['aa']} + {v['bb']} AS {c}_{b}_r2, {v['ab']} - {v['ba']} AS {c}_{b}_i2"]
            for g in "12":
                size = lambda c: f"{c}_{b}_r{g} * {c}_{b}_r{g} + {c}_{b}_i{g} * {c}_{b}_i{g}"  # noqa: B023, E731
                picks += [f"CASE WHEN {size('vis')} >= {size('ir')} THEN vis_{b}_{p}{g} ELSE ir_{b}_{p}{g} END AS {b}_{p}{g}" for p in "ri"]
            mixed["aa"].append(f"({b}_r1 + {b}_r2) / 2 AS {b}")
            mixed["bb"].append(f"({b}_r2 - {b}_r1) / 2 AS {b}")
            mixed["ab"].append(f"({b}_i1 + {b}_i2) / 2 AS {b}")
            mixed["ba"].append(f"({b}_i1 - {b}_i2) / 2 AS {b}")
        joined = f"t{k}_aa aa " + " ".join(f"JOIN t{k}_{t} {t} USING (pair_id, y, x)" for t in wavelets.TREES[1:])
        parts.append(f"z{k} AS MATERIALIZED (SELECT pair_id, y, x, {', '.join(z)} FROM {joined}), p{k} AS MATERIALIZED (SELECT pair_id, y, x, {', '.join(picks)} FROM z{k})")
        low = dict(zip("ab", (wavelets.QUARTER_A, wavelets.QUARTER_B) if k else (wavelets.FIRST_A, wavelets.FIRST_B)))
        for t in wavelets.TREES:
            parts.append(f"d{k}_{t} AS (SELECT pair_id, y, x, f AS LL, {', '.join(mixed[t])} FROM p{k} JOIN r{k + 1}_{t} USING (pair_id, y, x))")
            parts.append(synthesis_sql(f"r{k}_{t}", f"d{k}_{t}", low[t[0]], low[t[1]], lasts[k]))
    joined = "r0_aa aa " + " ".join(f"JOIN r0_{t} {t} USING (pair_id, y, x)" for t in wavelets.TREES[1:])
    f = "(aa.f + ab.f + ba.f + bb.f) / 4"
    return ", ".join(parts) + f" SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r6(f'least(greatest({f}, 0.0), 1.0)', 'f')} FROM {joined}"


def _four_levels(levels: int = 4) -> str:
    parts, _ = tree_levels(levels)
    rows = [f"SELECT {k + 1} AS level, '{t}' AS tree, pair_id, y, x, " + ", ".join(r6(f"vis_{b}", b) for b in wavelets.BANDS) + f" FROM t{k}_{t}" for k in range(levels) for t in wavelets.TREES]
    return ", ".join(parts) + " SELECT CAST(level AS INT) AS level, tree, pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(wavelets.BANDS) + f" FROM ({' UNION ALL '.join(rows)})"


@query("n20_dual_tree_four_levels", _four_levels())
def dual_tree_bands(spark, sf_dir):
    """All real bands of the four trees at the benchmark's four levels."""
    every = []
    for k, level in enumerate(wavelets.dual_tree_bands(pixels(spark, sf_dir), ["vis"]), 1):
        rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), *[rounded(F.col(f"vis_{t}_{b}")).alias(b) for b in wavelets.BANDS]) for t in wavelets.TREES]))
        every.append(level.select(F.lit(k).alias("level"), "pair_id", "y", "x", rows.alias("r")).select("level", "r.tree", "pair_id", "y", "x", *[f"r.{b}" for b in wavelets.BANDS]))
    return reduce(DataFrame.unionByName, every)


@query("n20_f13_dual_tree_same_sources", f"WITH {PX} SELECT pair_id, y, x, {r6('vis', 'f')} FROM px")
def dual_tree_same(spark, sf_dir):
    """Fusing an image with itself gives the image: perfect reconstruction of both trees (the quarter-shift taps are published with 8 digits, so deeper levels are a test)."""
    px = pixels(spark, sf_dir).withColumn("ir", F.col("vis"))
    return out(wavelets.dual_tree_fusion(px, 1), "f")


@query("f12_db4_fusion", db4_sql(3))
def db4_fusion(spark, sf_dir):
    """At the benchmark's three levels."""
    return out(wavelets.db4_fusion(pixels(spark, sf_dir), 3), "f")


@query("f13_dual_tree_fusion", dual_tree_sql(4))
def dual_tree_fusion(spark, sf_dir):
    """At the benchmark's four levels."""
    return out(wavelets.dual_tree_fusion(pixels(spark, sf_dir), 4), "f")


@query("n21_box_mean", f"WITH {RASTER}, {taps_sql(filters.box_taps(7))}, {stencil_sql('px', ['vis'], 63, 'symmetric', 's')} SELECT pair_id, y, x, {r6('vis', 'vis')} FROM s")
def box_mean(spark, sf_dir):
    return out(filters.box_mean(raster(spark, sf_dir), ["vis"], 7), "vis")


# --- fusion
@query("f01_f02_base_and_max", f"WITH {PX} SELECT pair_id, y, x, {r6('(vis + ir) / 2', 'f')}, {r6('greatest(vis, ir)', 'most')} FROM px")
def base_and_max(spark, sf_dir):
    return out(fusion.average(pixels(spark, sf_dir)).withColumn("most", F.greatest("vis", "ir")), "f", "most")


@query("f03_f04_f05_selections", f"""WITH {PX} SELECT pair_id, y, x, {r6("CASE WHEN abs(vis - 0.5) >= abs(ir - 0.5) THEN vis - 0.5 ELSE ir - 0.5 END", "far")},
  {r6("CASE WHEN ir >= vis THEN vis ELSE ir END", "act")}, {r6("CASE WHEN abs(2 * vis - 1) >= abs(2 * ir - 1) THEN 2 * vis ELSE 2 * ir END", "ratio")} FROM px""")
def selections(spark, sf_dir):
    v, i = F.col("vis"), F.col("ir")
    chosen = {"far": scalar.max_abs(v - 0.5, i - 0.5), "act": scalar.by_activity(i, v, v, i), "ratio": scalar.farthest_from_one(2 * v, 2 * i)}
    return out(pixels(spark, sf_dir).withColumns(chosen), *chosen)


@query("f07_weighted_top_hat", fused_sql("wd + wl", "bd + bl", M))
def weighted_top_hat(spark, sf_dir):
    return out(fusion.weighted_top_hat(pixels(spark, sf_dir), R, M), "f")


@query("f08_classic_top_hat", fused_sql("wd", "bd", 1.0))
def classic_top_hat(spark, sf_dir):
    return out(fusion.classic_top_hat(pixels(spark, sf_dir), R, 1.0), "f")


def pyramid_sql(levels: int) -> tuple[str, list[int]]:
    """CTEs px = g0, g1, ... of a Gaussian pyramid of vis and ir over 8 x 8 pairs, and each one's last place."""
    parts, lasts, was = [f"WITH {PX}, {taps_sql(filters.PYRAMID_TAPS)}, g0 AS (SELECT * FROM px)"], [7], "g0"
    for k in range(1, levels):
        parts.append(stencil_sql(was, ["vis", "ir"], lasts[-1], "mirror", f"s{k}"))
        parts.append(f"g{k} AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, vis, ir FROM s{k} WHERE y % 2 = 0 AND x % 2 = 0)")
        lasts.append(lasts[-1] // 2)
        was = f"g{k}"
    return ", ".join(parts), lasts


def blown_up(small: str, to: str, last: int, column: str) -> str:
    """up_sql; a single place blown up to a single place is itself."""
    return up_sql(small, to, last, column) if last else f"{to} AS (SELECT pair_id, y, x, {column} FROM {small})"


def laplacian_sql(levels: int) -> str:
    head, lasts = pyramid_sql(levels)
    parts = [head, f"r{levels - 1} AS (SELECT pair_id, y, x, (vis + ir) / 2 AS vis FROM g{levels - 1})"]
    for k in range(levels - 2, -1, -1):
        parts += [blown_up(f"g{k + 1}", f"uv{k}", lasts[k], "vis"), blown_up(f"g{k + 1}", f"ui{k}", lasts[k], "ir"), blown_up(f"r{k + 1}", f"ur{k}", lasts[k], "vis")]
        parts.append(f"d{k} AS (SELECT g.pair_id, g.y, g.x, g.vis - v.vis AS vis, g.ir - i.ir AS ir FROM g{k} g JOIN uv{k} v USING (pair_id, y, x) JOIN ui{k} i USING (pair_id, y, x))")
        parts += [f"ab{k} AS (SELECT pair_id, y, x, abs(vis) AS vis, abs(ir) AS ir FROM d{k})", stencil_sql(f"ab{k}", ["vis", "ir"], lasts[k], "mirror", f"act{k}")]
        parts.append(f"r{k} AS (SELECT d.pair_id, d.y, d.x, u.vis + CASE WHEN a.vis >= a.ir THEN d.vis ELSE d.ir END AS vis FROM d{k} d JOIN act{k} a USING (pair_id, y, x) JOIN ur{k} u USING (pair_id, y, x))")
    return ", ".join(parts) + f" SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r6('least(greatest(vis, 0.0), 1.0)', 'f')} FROM r0"


def ratio_sql(levels: int) -> str:
    head, lasts = pyramid_sql(levels + 1)
    parts = [head, f"r{levels} AS (SELECT pair_id, y, x, (vis + ir) / 2 AS vis FROM g{levels})"]
    for k in range(levels - 1, -1, -1):
        parts += [blown_up(f"g{k + 1}", f"uv{k}", lasts[k], "vis"), blown_up(f"g{k + 1}", f"ui{k}", lasts[k], "ir"), blown_up(f"r{k + 1}", f"ur{k}", lasts[k], "vis")]
        parts.append(f"""q{k} AS (SELECT g.pair_id, g.y, g.x, (g.vis + 1e-6) / (v.vis + 1e-6) AS a, (g.ir + 1e-6) / (i.ir + 1e-6) AS b, u.vis AS up
  FROM g{k} g JOIN uv{k} v USING (pair_id, y, x) JOIN ui{k} i USING (pair_id, y, x) JOIN ur{k} u USING (pair_id, y, x)),
r{k} AS (SELECT pair_id, y, x, CASE WHEN abs(a - 1) >= abs(b - 1) THEN a ELSE b END * (up + 1e-6) AS vis FROM q{k})""")
    return ", ".join(parts) + f" SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r6('least(greatest(vis, 0.0), 1.0)', 'f')} FROM r0"


@query("f09_laplacian_fusion", laplacian_sql(4))
def laplacian_fusion(spark, sf_dir):
    """At the benchmark's four levels."""
    return out(fusion.laplacian(pixels(spark, sf_dir), 4), "f")


@query("f10_ratio_fusion", ratio_sql(4))
def ratio_fusion(spark, sf_dir):
    """At the benchmark's four levels."""
    return out(fusion.ratio(pixels(spark, sf_dir), 4), "f")


def _haar_cell(c: str, sy: str, sx: str) -> str:
    return f"sum({c} * CASE WHEN {sy} = 0 THEN 1 ELSE -1 END * CASE WHEN {sx} = 0 THEN 1 ELSE -1 END) / 2"


def haar_sql(levels: int) -> str:
    """Levels of 2 x 2 cells of both sources down, then the chosen details up from the mean of the last."""
    parts = [f"WITH {PX}, h0 AS (SELECT * FROM px)"]
    kinds = (("a", "0", "0"), ("h", "y % 2", "0"), ("v", "0", "x % 2"), ("d", "y % 2", "x % 2"))
    for k in range(levels):
        cells = ", ".join(f"{_haar_cell(c, sy, sx)} AS {c}_{n}" for c in ("vis", "ir") for n, sy, sx in kinds)
        parts.append(f"q{k} AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, {cells} FROM h{k} GROUP BY 1, 2, 3), h{k + 1} AS (SELECT pair_id, y, x, vis_a AS vis, ir_a AS ir FROM q{k})")
    parts.append(f"r{levels} AS (SELECT pair_id, y, x, (vis + ir) / 2 AS f FROM h{levels})")
    for k in range(levels - 1, -1, -1):
        pick = ", ".join(f"CASE WHEN abs(vis_{n}) >= abs(ir_{n}) THEN vis_{n} ELSE ir_{n} END AS {n}" for n in "hvd")
        parts.append(f"""s{k} AS (SELECT pair_id, y, x, f AS a, {pick} FROM q{k} JOIN r{k + 1} USING (pair_id, y, x)),
r{k} AS (SELECT pair_id, 2 * y + i.range AS y, 2 * x + j.range AS x, (a + (1 - 2 * i.range) * h + (1 - 2 * j.range) * v + (1 - 2 * i.range) * (1 - 2 * j.range) * d) / 2 AS f FROM s{k}, range(2) i, range(2) j)""")
    return ", ".join(parts) + f" SELECT pair_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r6('least(greatest(f, 0.0), 1.0)', 'f')} FROM r0"


@query("f06_f11_haar_fusion", haar_sql(3))
def haar_fusion(spark, sf_dir):
    """At the benchmark's three levels, which 8 x 8 pairs take exactly."""
    return out(fusion.haar(pixels(spark, sf_dir), 3), "f")


@query("f14_j06_fan_out", f"""WITH {PX} SELECT method, pair_id, {r6("sum(CASE method WHEN 'average' THEN (vis + ir) / 2 WHEN 'vis' THEN vis ELSE ir END)", "total")}
FROM px CROSS JOIN (VALUES ('average'), ('vis'), ('ir')) m(method) GROUP BY 1, 2""")
def fan_out(spark, sf_dir):
    wanted = {n: fusion.METHODS[n] for n in ("average", "vis", "ir")}
    return fusion.fan_out(pixels(spark, sf_dir), wanted).groupBy("method", "pair_id").agg(rounded(F.sum("f")).alias("total"))


# --- metrics
def metric(name: str, sql: str, *columns: str, rasters: bool = False):
    """A metric's query over px with the plain f."""
    base = f"WITH {RASTER if rasters else PX}, {FUSED}, " + sql

    def keep(f):
        @query(name, base)
        def run(spark, sf_dir):
            return out(f(with_fused((raster if rasters else pixels)(spark, sf_dir))), *(columns or ("value",)), keys=("pair_id",))

        return run

    return keep


def hist_sql(c: str, to: str, bins: int = 256) -> str:
    return f"{to}0 AS (SELECT pair_id, CAST(least(floor({c} * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS n FROM fx WHERE {c} BETWEEN 0 AND 1 GROUP BY 1, 2), {to} AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY pair_id) AS DOUBLE) AS p FROM {to}0)"


def entropy_sql(c: str, to: str) -> str:
    """All 256 bins, empty ones too."""
    return f"""{hist_sql(c, to + "h")}, {to} AS (SELECT k.pair_id, -sum((coalesce(p, 0) + 1e-12) / (1 + 256e-12) * log2((coalesce(p, 0) + 1e-12) / (1 + 256e-12))) AS value
  FROM (SELECT DISTINCT pair_id, r.range AS bin FROM fx, range(256) r) k LEFT JOIN {to}h h ON h.pair_id = k.pair_id AND h.bin = k.bin GROUP BY 1)"""


@query("m00_histogram", f"WITH {PX}, {FUSED}, {hist_sql('f', 'h')} SELECT pair_id, bin, n, {r6('p', 'p')} FROM h")
def histogram(spark, sf_dir):
    return metrics.histogram(with_fused(pixels(spark, sf_dir)), "f").withColumn("p", rounded(F.col("p")))


metric("m01_entropy", f"{entropy_sql('f', 'en')} SELECT pair_id, {r6('value', 'value')} FROM en")(lambda px: metrics.entropy(px, "f"))
metric("m02_std_dev", f"z AS (SELECT 1) SELECT pair_id, {r6('stddev_pop(f)', 'value')} FROM fx GROUP BY 1")(metrics.std_dev)
metric("m03_fusion_efficiency", f"{entropy_sql('f', 'ef')}, {entropy_sql('vis', 'ev')}, {entropy_sql('ir', 'ei')} SELECT pair_id, {r6('ef.value / ((ev.value + ei.value) / 2 + 1e-12)', 'value')} FROM ef JOIN ev USING (pair_id) JOIN ei USING (pair_id)")(metrics.fusion_efficiency)
metric("m04_mean_gradient", f"{gradient_sql('fx', ['f'], 'gr')} SELECT pair_id, {r6('avg(sqrt(f_gx * f_gx + f_gy * f_gy))', 'value')} FROM gr GROUP BY 1")(metrics.mean_gradient)


def info_sql(source: str, a: str, b: str, to: str) -> str:
    lv = lambda c: f"CAST(floor(least(greatest({c}, 0.0), 1.0) * 63) AS INT)"
    return f"""{to}j AS (SELECT pair_id, {lv(a)} AS a, {lv(b)} AS b, count(*) / CAST((SELECT count(*) FROM fx WHERE pair_id = (SELECT min(pair_id) FROM fx)) AS DOUBLE) AS p FROM {source} GROUP BY 1, 2, 3),
{to}a AS (SELECT pair_id, a, sum(p) AS p FROM {to}j GROUP BY 1, 2), {to}b AS (SELECT pair_id, b, sum(p) AS p FROM {to}j GROUP BY 1, 2),
{to} AS (SELECT j.pair_id, sum(j.p * log2(j.p / (x.p * y.p))) AS mi, (SELECT -sum(p * log2(p)) FROM {to}a q WHERE q.pair_id = j.pair_id) AS ha, (SELECT -sum(p * log2(p)) FROM {to}b q WHERE q.pair_id = j.pair_id) AS hb
  FROM {to}j j JOIN {to}a x ON x.pair_id = j.pair_id AND x.a = j.a JOIN {to}b y ON y.pair_id = j.pair_id AND y.b = j.b GROUP BY j.pair_id)"""


metric("m05_mutual_information", f"{info_sql('fx', 'f', 'vis', 'i')} SELECT pair_id, {r6('mi', 'value')} FROM i")(metrics.mutual_information)
metric("m06_spatial_frequency", f"""d AS (SELECT a.pair_id, avg(power(255 * (b.f - a.f), 2)) FILTER (b.x = a.x + 1) AS r, avg(power(255 * (b.f - a.f), 2)) FILTER (b.y = a.y + 1) AS c
  FROM fx a JOIN fx b ON b.pair_id = a.pair_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY 1) SELECT pair_id, {r6("sqrt(r + c)", "value")} FROM d""")(metrics.spatial_frequency)  # fmt: skip


def edges_sql(kind: str) -> str:
    q = lambda s: f"""0.9994 / (1 + exp(-15.0 * (CASE WHEN {s}.g > sf.g THEN sf.g / ({s}.g + 1e-12) WHEN {s}.g < sf.g THEN {s}.g / (sf.g + 1e-12) ELSE sf.g END - 0.5)))
    * 0.9879 / (1 + exp(-22.0 * (1 - abs({s}.a - sf.a) / (pi() / 2) - 0.8)))"""  # noqa: E731
    return f"""{sobel_sql("fx", "vis", kind, "sv")}, {sobel_sql("fx", "ir", kind, "si")}, {sobel_sql("fx", "f", kind, "sf")},
z AS (SELECT pair_id, sv.g AS gv, si.g AS gi, sf.g AS gf, {q("sv")} AS qv, {q("si")} AS qi FROM sv JOIN si USING (pair_id, y, x) JOIN sf USING (pair_id, y, x))
SELECT pair_id, {r6("sum(qv * gv + qi * gi) / (sum(gv + gi) + 1e-12)", "qabf")}, {r6("sum(CASE WHEN gf > gv AND gf > gi THEN (1 - qv) * gv + (1 - qi) * gi ELSE 0 END) / (sum(gv + gi) + 1e-12)", "nabf")} FROM z GROUP BY 1"""


metric("m07_edge_quality", edges_sql("edge"), "qabf", "nabf")(metrics.edge_quality)
metric("m07_edge_quality_fast", edges_sql("mirror"), "qabf", "nabf")(lambda px: metrics.edge_quality(px, True))

MOM = "mo AS (SELECT pair_id, y, x, f, vis, ir, f * f AS ff, vis * vis AS vv, ir * ir AS ii, f * vis AS fv, f * ir AS fi FROM fx)"
MCOLS = ["f", "vis", "ir", "ff", "vv", "ii", "fv", "fi"]


def ssim_sql(scale: str, eps: str) -> str:
    one = lambda m, mm, fm: f"((2 * f * {m} + 0.0001) * (2 * ({fm} - f * {m}) * {scale} + 0.0009)) / ((f * f + {m} * {m} + 0.0001) * ((ff - f * f) * {scale} + ({mm} - {m} * {m}) * {scale} + 0.0009) + {eps})"
    return f"SELECT pair_id, {r6(f'(avg({one("vis", "vv", "fv")}) + avg({one("ir", "ii", "fi")})) / 2', 'value')} FROM s GROUP BY 1"


metric("m08_ssim", f"{MOM}, {taps_sql(filters.box_taps(7))}, {stencil_sql('mo', MCOLS, 7, 'valid', 's')} {ssim_sql('(CAST(49 AS DOUBLE) / 48)', '0')}")(metrics.ssim)
metric("m17_ssim_fast", f"{MOM}, {taps_sql(filters.gaussian_taps(11, 1.5))}, {stencil_sql('mo', MCOLS, 7, 'mirror', 's')} {ssim_sql('1', '1e-12')}")(metrics.ssim_fast)


def corr_sql(a: str, b: str) -> str:
    return f"sum(({a} - m_{a}) * ({b} - m_{b})) / (sqrt(sum(power({a} - m_{a}, 2)) * sum(power({b} - m_{b}, 2))) + 1e-12)"


metric("m09_m10_scd", f"""d AS (SELECT pair_id, f - ir AS a, f - vis AS b, vis, ir FROM fx), w AS (SELECT *, avg(a) OVER p AS m_a, avg(b) OVER p AS m_b, avg(vis) OVER p AS m_vis, avg(ir) OVER p AS m_ir FROM d WINDOW p AS (PARTITION BY pair_id))
SELECT pair_id, {r6(corr_sql("a", "vis") + " + " + corr_sql("b", "ir"), "value")} FROM w GROUP BY 1""")(metrics.scd)  # fmt: skip


def vif_one(s: str, ss: str, fs: str) -> str:
    s1, s2, c = f"greatest({ss} - {s} * {s}, 0)", "greatest(ff - f * f, 0)", f"({fs} - f * {s})"
    return f"SELECT pair_id, '{s}' AS s, {s1} AS s1, {s2} AS s2, {c} AS c FROM s"


metric("m11_vif_one_scale", f"""sc AS (SELECT pair_id, y, x, 255 * f AS f, 255 * vis AS vis, 255 * ir AS ir FROM fx), {MOM.replace("FROM fx", "FROM sc")}, {taps_sql(filters.gaussian_taps(17, 3.4))},
{stencil_sql("mo", MCOLS, 63, "valid", "s")}, m AS ({vif_one("vis", "vv", "fv")} UNION ALL {vif_one("ir", "ii", "fi")}),
g AS (SELECT pair_id, s, s2, CASE WHEN s1 < 1e-10 THEN 0 ELSE s1 END AS s1, CASE WHEN s1 < 1e-10 OR s2 < 1e-10 THEN 0 ELSE c / (s1 + 1e-10) END AS g,
  CASE WHEN s2 < 1e-10 THEN 0 WHEN s1 < 1e-10 THEN s2 ELSE s2 - c / (s1 + 1e-10) * c END AS sv FROM m),
h AS (SELECT pair_id, s, sum(log10(1 + power(greatest(g, 0), 2) * s1 / (greatest(CASE WHEN g < 0 THEN s2 ELSE sv END, 1e-10) + 2))) / (sum(log10(1 + s1 / 2)) + 1e-12) AS v FROM g GROUP BY 1, 2)
SELECT pair_id, {r6("avg(v)", "value")} FROM h GROUP BY 1""", rasters=True)(lambda px: metrics.vif(px, 1))  # fmt: skip

FEAT = f"{gradient_sql('fx', ['f', 'vis', 'ir'], 'gr')}, {feature_sql(['f', 'vis', 'ir'], 'fe')}"
metric("m12_feature_information", f"{FEAT}, {info_sql('fe', 'f', 'vis', 'iv')}, {info_sql('fe', 'f', 'ir', 'ii')} SELECT pair_id, {r6('CASE WHEN iv.ha + iv.hb > 1e-12 THEN iv.mi / (iv.ha + iv.hb) ELSE 0 END + CASE WHEN ii.ha + ii.hb > 1e-12 THEN ii.mi / (ii.ha + ii.hb) ELSE 0 END', 'value')} FROM iv JOIN ii USING (pair_id)")(metrics.feature_information)


def local_sql(source: str, to: str) -> str:
    q = lambda m, mm, fm: f"CASE WHEN (greatest({mm} - {m} * {m}, 0) + greatest(ff - f * f, 0)) * ({m} * {m} + f * f) > 1e-12 THEN 4 * ({fm} - {m} * f) * {m} * f / ((greatest({mm} - {m} * {m}, 0) + greatest(ff - f * f, 0)) * ({m} * {m} + f * f)) ELSE 1 END"
    return f"""{to}m AS (SELECT pair_id, y, x, f, vis, ir, f * f AS ff, vis * vis AS vv, ir * ir AS ii, f * vis AS fv, f * ir AS fi FROM {source}),
{stencil_sql(to + "m", MCOLS, 7, "symmetric", to + "s")}, {to}l AS (SELECT pair_id, greatest(vv - vis * vis, 0) AS sa, greatest(ii - ir * ir, 0) AS sb, {q("vis", "vv", "fv")} AS qa, {q("ir", "ii", "fi")} AS qb FROM {to}s),
{to} AS (SELECT pair_id, avg(sa / (sa + sb + 1e-12) * qa + (1 - sa / (sa + sb + 1e-12)) * qb) AS q0, sum(greatest(sa, sb) * (sa / (sa + sb + 1e-12) * qa + (1 - sa / (sa + sb + 1e-12)) * qb)) / (sum(greatest(sa, sb)) + 1e-12) AS qw FROM {to}l GROUP BY 1)"""


metric("m13_m14_m15_local_quality", f"{taps_sql(filters.box_taps(7))}, {FEAT}, {local_sql('fx', 'lp')}, {local_sql('fe', 'le')} SELECT pair_id, {r6('lp.q0', 'q0')}, {r6('lp.qw', 'qw')}, {r6('lp.qw * le.qw', 'qe')} FROM lp JOIN le USING (pair_id)", "q0", "qw", "qe")(metrics.local_quality)
metric("m18_entropy_share", f"{hist_sql('f', 'h')} SELECT pair_id, {r6('-sum(p * log2(p)) / 8', 'value')} FROM h GROUP BY 1")(lambda px: metrics.entropy(px, "f", floor=0.0).withColumn("value", F.col("value") / 8.0))
metric("m19_psnr_share", f"z AS (SELECT 1) SELECT pair_id, {r6('log10(1 / greatest((avg(power(f - vis, 2)) + avg(power(f - ir, 2))) / 2, 1e-12)) / 10', 'value')} FROM fx GROUP BY 1")(metrics.psnr_share)


def vif_sql(scales: int) -> str:
    """Every scale of the 64 x 64 pairs: blurred and halved from the second on, then local moments of each window."""
    columns, parts, was, last = ["f", "vis", "ir"], ["sc1 AS (SELECT pair_id, y, x, 255 * f AS f, 255 * vis AS vis, 255 * ir AS ir FROM fx)"], "sc1", 63
    for k in range(1, scales + 1):
        n = 2 ** (5 - k) + 1
        parts.append(taps_sql(filters.gaussian_taps(n, n / 5.0), f"t{k}"))
        if k > 1:
            half = n // 2
            parts.append(stencil_sql(was, columns, last, "valid", f"bl{k}", f"t{k}"))
            parts.append(f"sc{k} AS (SELECT pair_id, (y - {half}) // 2 AS y, (x - {half}) // 2 AS x, f, vis, ir FROM bl{k} WHERE (y - {half}) % 2 = 0 AND (x - {half}) % 2 = 0)")
            was, last = f"sc{k}", (last - 2 * half) // 2
        parts.append(MOM.replace("FROM fx", f"FROM {was}").replace("mo AS", f"mo{k} AS"))
        parts.append(stencil_sql(f"mo{k}", MCOLS, last, "valid", f"st{k}", f"t{k}"))
        parts.append(f"m{k} AS ({vif_one('vis', 'vv', 'fv').replace('FROM s', f'FROM st{k}')} UNION ALL {vif_one('ir', 'ii', 'fi').replace('FROM s', f'FROM st{k}')})")
    every = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, scales + 1))
    return ", ".join(parts) + f""", m AS ({every}), g AS (SELECT pair_id, s, s2, CASE WHEN s1 < 1e-10 THEN 0 ELSE s1 END AS s1, CASE WHEN s1 < 1e-10 OR s2 < 1e-10 THEN 0 ELSE c / (s1 + 1e-10) END AS g,
  CASE WHEN s2 < 1e-10 THEN 0 WHEN s1 < 1e-10 THEN s2 ELSE s2 - c / (s1 + 1e-10) * c END AS sv FROM m),
h AS (SELECT pair_id, s, sum(log10(1 + power(greatest(g, 0), 2) * s1 / (greatest(CASE WHEN g < 0 THEN s2 ELSE sv END, 1e-10) + 2))) / (sum(log10(1 + s1 / 2)) + 1e-12) AS v FROM g GROUP BY 1, 2)
SELECT pair_id, {r6("avg(v)", "value")} FROM h GROUP BY 1"""


metric("m11_vif", vif_sql(4), rasters=True)(metrics.vif)

#: The other fifteen of the record, by the queries above: name -> (query, its column).
RECORD = {
    "EN": ("m01_entropy", "value"), "SD": ("m02_std_dev", "value"), "FE": ("m03_fusion_efficiency", "value"), "MG": ("m04_mean_gradient", "value"), "MI_vis": ("m05_mutual_information", "value"),
    "SF": ("m06_spatial_frequency", "value"), "Qabf": ("m07_edge_quality", "qabf"), "Nabf": ("m07_edge_quality", "nabf"), "SSIM": ("m08_ssim", "value"), "SCD": ("m09_m10_scd", "value"),
    "FMI": ("m12_feature_information", "value"), "Q0": ("m13_m14_m15_local_quality", "q0"), "QW": ("m13_m14_m15_local_quality", "qw"), "QE": ("m13_m14_m15_local_quality", "qe"),
}


def record_sql() -> str:
    used = sorted({q for q, _ in RECORD.values()})
    joined = " JOIN ".join(f"({ORACLES[q]}) {q}" + (" USING (pair_id)" if i else "") for i, q in enumerate(used))
    return "SELECT pair_id, " + ", ".join(f"{q}.{c} AS {n}" for n, (q, c) in RECORD.items()) + f" FROM {joined}"


@query("m16_evaluate_pairs", record_sql())
def evaluate_pairs(spark, sf_dir):
    """The record of the plain f on all 8 x 8 pairs, which are too small for VIF; one pass against each metric's own SQL."""
    return out(metrics.evaluate(with_fused(pixels(spark, sf_dir)), with_vif=False), *RECORD, keys=("pair_id",))


#: The benchmark's seven methods: name -> SQL of f with 6 digits.
SEVEN = {
    "proposal": top_hat_sql(PX, WIDE_R, 7, M), "classic": top_hat_sql(PX, 5, 7, 1.0, "wd", "bd"), "laplacian": laplacian_sql(4), "ratio": ratio_sql(4),
    "haar": haar_sql(3), "db4": db4_sql(3), "dual_tree": dual_tree_sql(4),
}


def seven_sql() -> str:
    """CTEs up to f7(pair_id, y, x, vis, ir, f), method and pair as one name."""
    rows = [f"SELECT '{m}:' || pair_id AS pair_id, y, x, vis, ir, f FROM px JOIN ({sql}) q USING (pair_id, y, x)" for m, sql in SEVEN.items()]
    return f"WITH {PX}, f7 AS MATERIALIZED ({' UNION ALL '.join(rows)})"


def benchmark_sql() -> str:
    of_f7 = lambda sql: sql.replace(f"WITH {PX}, {FUSED}, ", "WITH fx AS (SELECT * FROM f7), ")
    record = RECORD | {"MI_ir": ("mi_ir", "value")}
    texts = {q: of_f7(ORACLES[q]) for q, _ in RECORD.values()} | {"mi_ir": of_f7(f"WITH {PX}, {FUSED}, {info_sql('fx', 'f', 'ir', 'i')} SELECT pair_id, {r6('mi', 'value')} FROM i")}
    joined = " JOIN ".join(f"({sql}) {q}" + (" USING (pair_id)" if i else "") for i, (q, sql) in enumerate(texts.items()))
    columns = ", ".join(f"{q}.{c} AS {n}" for n, (q, c) in record.items())
    return f"{seven_sql()} SELECT split_part(pair_id, ':', 1) AS method, CAST(split_part(pair_id, ':', 2) AS BIGINT) AS pair_id, {columns}, CAST(NULL AS DOUBLE) AS VIF FROM {joined}"


@query("f14_j06_seven_methods", f"{seven_sql()} SELECT split_part(pair_id, ':', 1) AS method, CAST(split_part(pair_id, ':', 2) AS BIGINT) AS pair_id, y, x, f FROM f7")
def seven_methods(spark, sf_dir):
    """The fan-out of all seven methods at their published parameters."""
    fused = fusion.fan_out(pixels(spark, sf_dir), {m: fusion.METHODS[m] for m in SEVEN})
    return fused.select("method", "pair_id", "y", "x", rounded(F.col("f")).alias("f"))


@query("a21_benchmark", benchmark_sql())
def benchmark(spark, sf_dir):
    """Fuse, measure, append: one method on half of the pairs, then seven on all; the second run does what the first left out. VIF is null: 8 x 8 pairs are too small for it."""
    px = staged(pixels(spark, sf_dir))
    bench = flows.Benchmark(spark, new_path(spark, "benchmark"), digits=6)
    methods = {m: fusion.METHODS[m] for m in SEVEN}
    bench.run(px.where(F.col("pair_id") % 2 == 0), {"classic": methods["classic"]}, with_vif=False)
    return bench.run(px, methods, with_vif=False).select("method", "pair_id", *[rounded(F.col(c)).alias(c) for c in flows.RECORD])


@query("m16_evaluate_all")
def evaluate_all(spark, sf_dir):
    """All sixteen metrics of the plain f on the rasters; each has its own SQL above."""
    px = with_fused(raster(spark, sf_dir))
    return metrics.evaluate(px)
