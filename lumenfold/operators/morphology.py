"""Morphology on pixel relations (keys..., y, x, value columns), as window frames over coordinates.

A line of half length k is a range frame along its direction; a disk is, for each distinct half width h of
its rows, a frame of that width along x followed by one along y over the rows that are at least that wide.
Frames end at the image's border, so pixels outside never count. All columns given go through the same
windows: a direction costs one sort, whatever the number of columns, and ``co_partition`` beforehand leaves
one shuffle for the whole chain.

A frame costs its width for each pixel. From half lengths of ``WIDE`` on, a line is taken by doubling instead: the
extremes of 1, 2, 4, ... pixels ahead and behind come one from the other by a lookup, and two overlapping ones cover any
length, so a pixel costs the logarithm of the width. A disk takes its row widths from the same tables, then
looks up one row for each offset. Lookups count places, so lines with missing pixels are an error there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = (0, 45, 90, 135)
WIDE = 4


def disk_rows(r: float) -> dict[int, int]:
    """Row offset -> half width of the disk of radius r (at least 1)."""
    r = max(1, round(r))
    return {dy: round(math.sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)}


def line_half_length(r: float, direction: int) -> int:
    """Half length in pixels of a line of radius r; diagonals are shorter."""
    r = max(1, round(r))
    return r if direction in (0, 90) else round(r + r * math.cos(math.pi / 4)) - r


def co_partition(px: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px hashed by its keys once: all windows below partition by supersets of them and need no further shuffle."""
    return px.repartition(*keys)


def _line_window(keys: tuple[str, ...], direction: int) -> Window:
    across, along = {
        0: (F.col("y"), "x"), 90: (F.col("x"), "y"), 45: (F.col("x") + F.col("y"), "x"), 135: (F.col("x") - F.col("y"), "x")
    }[direction]
    return Window.partitionBy(*keys, across).orderBy(along)


def _whole(px: DataFrame, w: Window, axis: str) -> DataFrame:
    """px; a line of w with a gap raises an error when it is read."""
    line = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    there = F.count(F.lit(1)).over(line) == F.max(axis).over(line) - F.min(axis).over(line) + 1
    gap = F.raise_error(F.lit("morphology of this radius needs lines without missing pixels"))
    return px.withColumn("_whole", there).withColumn(axis, F.when(F.col("_whole"), F.col(axis)).otherwise(gap.cast("int"))).drop("_whole")


def sliding(px: DataFrame, wanted: dict[str, tuple[str, str, int]], w: Window, axis: str) -> DataFrame:
    """px with, for each new column, the min or max ("min" | "max", source, k) over k places to both sides along w, by doubling."""
    pick = {"min": F.least, "max": F.greatest}  # both pass over nulls, which stand past a line's ends
    tables = {(how, source): max(k for h, s, k in wanted.values() if (h, s) == (how, source)) for how, source, _ in wanted.values()}
    name = lambda how, source, side, j: source if j == 0 else f"_{how}_{source}_{side}{j}"
    shift = {"ahead": F.lead, "behind": F.lag}
    made: list[str] = []
    px = _whole(px, w, axis)
    for j in range(max(tables.values()).bit_length()):
        step = {}
        for (how, source), most in tables.items():
            if 2 << j <= most + 1:
                for side, look in shift.items():
                    was = name(how, source, side, j)
                    step[name(how, source, side, j + 1)] = pick[how](F.col(was), look(was, 1 << j).over(w))
        if step:
            px = px.withColumns(step)
            made += step
    out = {}
    for new, (how, source, k) in wanted.items():
        j = (k + 1).bit_length() - 1
        parts = []
        for side, look in shift.items():
            was = name(how, source, side, j)
            parts += [F.col(was)] + ([look(was, k + 1 - (1 << j)).over(w)] if k + 1 > 1 << j else [])
        out[new] = pick[how](*parts)
    return px.withColumns(out).drop(*made)


def line_filter(px: DataFrame, columns: dict[str, tuple[str, str]], k: int, direction: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with, for each new column, the min or max ("min" | "max", source) along a line of half length k."""
    if k >= WIDE:
        return sliding(px, {new: (*of, k) for new, of in columns.items()}, _line_window(keys, direction), "y" if direction == 90 else "x")
    w = _line_window(keys, direction).rangeBetween(-k, k)
    return px.withColumns({new: getattr(F, how)(source).over(w) for new, (how, source) in columns.items()})


def disk_filter(px: DataFrame, columns: dict[str, tuple[str, str]], r: float, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with the min or max over a disk."""
    rows = disk_rows(r)
    if max(rows) >= WIDE:
        return _wide_disk(px, columns, rows, keys)
    reach = {h: max(dy for dy, other in rows.items() if other >= h) for h in set(rows.values())}
    along_x, along_y = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    part = {new: {h: f"_{new}_{h}" for h in reach} for new in columns}
    out = px.withColumns({part[new][h]: getattr(F, how)(src).over(along_x.rangeBetween(-h, h)) for new, (how, src) in columns.items() for h in reach})
    out = out.withColumns({f"{part[new][h]}y": getattr(F, how)(part[new][h]).over(along_y.rangeBetween(-d, d)) for new, (how, _) in columns.items() for h, d in reach.items()})

    def joined(new: str, how: str) -> Column:
        cols = [F.col(f"{part[new][h]}y") for h in reach]
        return cols[0] if len(cols) == 1 else (F.least if how == "min" else F.greatest)(*cols)

    out = out.withColumns({new: joined(new, how) for new, (how, _) in columns.items()})
    return out.drop(*[c for names in part.values() for n in names.values() for c in (n, f"{n}y")])


def _wide_disk(px: DataFrame, columns: dict[str, tuple[str, str]], rows: dict[int, int], keys: tuple[str, ...]) -> DataFrame:
    part = {new: {h: f"_{new}_{h}" for h in set(rows.values())} for new in columns}
    wanted = {part[new][h]: (how, source, h) for new, (how, source) in columns.items() for h in part[new] if h}
    along_x, along_y = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    out = _whole(sliding(px, wanted, along_x, "x"), along_y, "y")
    of = lambda new, h: part[new][h] if h else columns[new][1]
    look = lambda c, dy: F.col(c) if dy == 0 else (F.lead if dy > 0 else F.lag)(c, abs(dy)).over(along_y)
    out = out.withColumns({new: {"min": F.least, "max": F.greatest}[how](*[look(of(new, h), dy) for dy, h in rows.items()]) for new, (how, _) in columns.items()})
    return out.drop(*wanted)


def open_close(px: DataFrame, columns: list[str], shape: str | int, r: float, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with <column>_open and <column>_close by "disk" or a line's direction."""
    def run(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        if shape == "disk":
            return disk_filter(df, wanted, r, keys)
        return line_filter(df, wanted, line_half_length(r, shape), shape, keys)

    px = run(px, {f"_{c}_{how}": (how, c) for c in columns for how in ("min", "max")})
    px = run(px, {new: x for c in columns for new, x in ((f"{c}_open", ("max", f"_{c}_min")), (f"{c}_close", ("min", f"_{c}_max")))})
    return px.drop(*[f"_{c}_{how}" for c in columns for how in ("min", "max")])


def top_hats(px: DataFrame, columns: list[str], shape: str | int, r: float, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with <column>_wth = f - open and <column>_bth = close - f."""
    px = open_close(px, columns, shape, r, keys)
    hats = {f"{c}_wth": F.col(c) - F.col(f"{c}_open") for c in columns} | {f"{c}_bth": F.col(f"{c}_close") - F.col(c) for c in columns}
    return px.withColumns(hats).drop(*[f"{c}_{k}" for c in columns for k in ("open", "close")])


def combined_top_hats(px: DataFrame, columns: list[str], r: float, mode: str = "sum", keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with <column>_wth and <column>_bth of the disk and the mean of four lines: "sum", "avg" (half the sum) or "max" (N7)."""
    if mode not in ("sum", "avg", "max"):
        raise ValueError("mode is 'sum', 'avg' or 'max'")
    hats = [f"{c}_{k}" for c in columns for k in ("wth", "bth")]
    for shape in ("disk", *DIRECTIONS):
        px = top_hats(px, columns, shape, r, keys)
        px = px.withColumnsRenamed({h: f"_{h}_{shape}" for h in hats})
    lines = {h: sum((F.col(f"_{h}_{d}") for d in DIRECTIONS), F.lit(0.0)) / float(len(DIRECTIONS)) for h in hats}
    both = {
        "sum": lambda a, b: a + b, "avg": lambda a, b: 0.5 * (a + b), "max": F.greatest,
    }[mode]
    px = px.withColumns({h: both(F.col(f"_{h}_disk"), lines[h]) for h in hats})
    return px.drop(*[f"_{h}_{s}" for h in hats for s in ("disk", *DIRECTIONS)])
