"""Fusion methods and metrics over whole images as arrays, many images of a size at once.

Rows are dealt by image and sorted within it, so an image is one run of rows, and a pass over it is one step of the plan
whatever the method: no window, no table in between. The relational forms in ``fusion``, ``wavelets`` and ``metrics``
say the same pixel by pixel; sums here take their terms in the same order. An image needs the memory of its pixels; what is too large
for that goes in tiles (``operators/tiles.py``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import filters, morphology, wavelets

Images = np.ndarray  # (n, height, width)
#: Images are taken together up to so many pixels and images; a larger image goes alone.
PIXELS, IMAGES = 1 << 16, 1 << 12


# --- images from rows
def _starts(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """The places where another image begins; a null key equals a null key."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        c = batch[k].combine_chunks()
        a, b = c[1:], c[:-1]
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def _floats(c: pa.ChunkedArray) -> np.ndarray:
    return c.cast(pa.float64()).to_numpy().astype(float, copy=False)


def _shape(y: np.ndarray, x: np.ndarray) -> tuple[int, int]:
    h, w = int(y[-1] - y[0]) + 1, int(x.max() - x[0]) + 1
    at = np.arange(len(y))
    if len(y) != h * w or not (np.array_equal(y - y[0], at // w) and np.array_equal(x - x[0], at % w)):
        raise ValueError(f"an image must be whole: {len(y)} pixels in {h} x {w} places")
    return h, w


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[pa.Table, list[Images]]]:
    """The rows of images of one size, in order, and their columns as arrays."""

    def sized(t: pa.Table) -> Iterator[tuple[pa.Table, list[Images]]]:
        cuts = [0, *_starts(t, keys), t.num_rows]
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            sizes.setdefault(_shape(y[a:b], x[a:b]), []).append(i)
        for (h, w), own in sizes.items():
            rows = t if len(sizes) == 1 else t.take(np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in own]))
            yield rows, [_floats(rows[c]).reshape(-1, h, w) for c in columns]

    def cut(t: pa.Table, ends: list[int]) -> Iterator[tuple[pa.Table, list[Images]]]:
        """The images up to the last end, at most IMAGES at once."""
        at = 0
        for end in [*ends[IMAGES - 1 : -1 : IMAGES], *ends[-1:]]:
            yield from sized(t.slice(at, end - at))
            at = end

    kept, pixels = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        pixels += batch.num_rows
        if pixels < PIXELS:
            continue
        t = pa.concat_tables(kept)
        ends = [int(i) for i in _starts(t, keys)]  # the last image may go on in the next batch
        yield from cut(t, ends)
        kept = [t.slice(ends[-1]) if ends else t]
        pixels = 0
    if kept:
        t = pa.concat_tables(kept)
        yield from cut(t, [*(int(i) for i in _starts(t, keys)), t.num_rows])


def _sorted(px: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    rows = px.select(*keys, "y", "x", *columns)
    return morphology.co_partition(rows, keys).sortWithinPartitions(*keys, "y", "x")


def _doubles(values: np.ndarray) -> pa.Array:
    """NaN is null, as it is for the relational forms."""
    return pa.array(values, pa.float64(), from_pandas=True)


def fused(px: DataFrame, methods: dict[str, Callable[[Images, Images], Images]], keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with an array column of f of all methods, in their order, as fs."""
    columns, names = ["vis", "ir"], list(keys)

    def run(batches):
        for rows, (vis, ir) in _groups(batches, names, columns):
            with np.errstate(all="ignore"):
                fs = np.stack([f(vis, ir) for f in methods.values()], -1)
            lists = pa.ListArray.from_arrays(np.arange(0, fs.size + 1, len(methods), dtype=np.int32), _doubles(fs.reshape(-1)))
            yield from rows.append_column("fs", lists).to_batches(1 << 15)

    rows = _sorted(px, columns, keys)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fs", ArrayType(DoubleType()))]))


def measured(px: DataFrame, keys: tuple[str, ...], names: list[str], measure: Callable[[Images, Images, Images], dict[str, np.ndarray]]) -> DataFrame:
    """keys and a row of measures of each image."""
    by = list(keys)

    def run(batches):
        for rows, (f, vis, ir) in _groups(batches, by, ["f", "vis", "ir"]):
            with np.errstate(all="ignore"):
                found = measure(f, vis, ir)
            first = rows.select(by).take(np.arange(len(f)) * f[0].size)
            for name in names:
                first = first.append_column(name, _doubles(found[name]))
            yield from first.combine_chunks().to_batches()

    rows = _sorted(px, ["f", "vis", "ir"], keys)
    return rows.mapInArrow(run, StructType([*[rows.schema[k] for k in keys], *[StructField(n, DoubleType()) for n in names]]))


# --- neighbours
def _shift(a: Images, dy: int, dx: int, fill: float) -> Images:
    """The value (dy, dx) places on; fill past the border."""
    h, w = a.shape[1:]
    out = np.full_like(a, fill)
    if abs(dy) < h and abs(dx) < w:
        out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[:, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _mirrored(size: int, k: int, off: int) -> np.ndarray:
    """The places that -k .. size - 1 + k stand for; off: 0 leaves the edge single, 1 repeats it."""
    period = 2 * (size - 1) + 2 * off
    at = np.arange(-k, size + k) % max(period, 1)
    return np.minimum(at, period - off - at)


def _along(a: Images, axis: int, at: np.ndarray) -> Images:
    return np.take(a, at, axis=axis)


def _taps(a: Images, taps: dict[int, float], off: int) -> Images:
    """Both axes, x first; the border is mirrored."""
    k = max(abs(d) for d in taps)
    for axis in (2, 1):
        size = a.shape[axis]
        wide = _along(a, axis, _mirrored(size, k, off))
        out = 0.0
        for d, weight in taps.items():
            out = out + weight * (wide[:, :, k + d : k + d + size] if axis == 2 else wide[:, k + d : k + d + size])
        a = out
    return a


def clip01(a: Images) -> Images:
    return np.minimum(np.maximum(a, 0.0), 1.0)


# --- morphology
LOW, HIGH = (np.minimum, math.inf), (np.maximum, -math.inf)


def _ahead(a: Images, k: int, dy: int, dx: int, op: Callable, fill: float) -> Images:
    """The extreme of a place and the k after it, by doubling."""
    n = 1
    while 2 * n <= k + 1:
        a, n = op(a, _shift(a, dy * n, dx * n, fill)), 2 * n
    return op(a, _shift(a, dy * (k + 1 - n), dx * (k + 1 - n), fill)) if n < k + 1 else a


def _line(a: Images, k: int, dy: int, dx: int, how: tuple[Callable, float]) -> Images:
    h, w = a.shape[1:]
    k = min([k, *([h - 1] if dy else []), *([w - 1] if dx else [])])
    return how[0](_ahead(a, k, dy, dx, *how), _ahead(a, k, -dy, -dx, *how))


STEPS = {0: (0, 1), 90: (1, 0), 45: (-1, 1), 135: (1, 1)}


def _spread(a: Images, shape: str | int, r: float, how: tuple[Callable, float]) -> Images:
    if shape != "disk":
        return _line(a, morphology.line_half_length(r, shape), *STEPS[shape], how)
    rows = {dy: width for dy, width in morphology.disk_rows(r).items() if abs(dy) < a.shape[1]}
    wide = {k: _line(a, k, 0, 1, how) for k in set(rows.values())}
    out = None
    for dy, k in rows.items():
        there = _shift(wide[k], dy, 0, how[1])
        out = there if out is None else how[0](out, there)
    return out


def _hats(a: Images, shape: str | int, r: float) -> tuple[Images, Images]:
    return a - _spread(_spread(a, shape, r, LOW), shape, r, HIGH), _spread(_spread(a, shape, r, HIGH), shape, r, LOW) - a


def _with_details(vis: Images, ir: Images, hats: Callable[[Images], tuple[Images, Images]], m: float) -> Images:
    (vw, vb), (iw, ib) = hats(vis), hats(ir)
    return clip01(0.5 * (vis + ir) + m * np.maximum(vw, iw) - m * np.maximum(vb, ib))


def weighted_top_hat(vis: Images, ir: Images, r: float = 3, m: float = 1.0) -> Images:
    def hats(a: Images) -> tuple[Images, Images]:
        disk, lines = _hats(a, "disk", r), [_hats(a, d, r) for d in morphology.DIRECTIONS]
        return tuple(disk[i] + sum((x[i] for x in lines), 0.0) / float(len(lines)) for i in (0, 1))

    return _with_details(vis, ir, hats, m)


def classic_top_hat(vis: Images, ir: Images, r: float = 5, m: float = 1.0) -> Images:
    return _with_details(vis, ir, lambda a: _hats(a, "disk", r), m)


# --- pyramids
def _down(a: Images) -> Images:
    return _taps(a, filters.PYRAMID_TAPS, 0)[:, ::2, ::2]


def _up(a: Images, like: Images) -> Images:
    """Blown up to the size of another."""
    for axis in (2, 1):
        size, at = a.shape[axis], np.arange(a.shape[axis])
        after = _along(a, axis, np.minimum(at + 1, size - 1))
        before = _along(a, axis, np.where(at > 0, at - 1, np.minimum(1, size - 1)))
        both = np.stack([0.125 * before + 0.75 * a + 0.125 * after, 0.5 * a + 0.5 * after], axis + 1)
        a = both.reshape(*a.shape[:axis], 2 * size, *a.shape[axis + 1 :])
    return a[:, : like.shape[1], : like.shape[2]]


def _pyramid(a: Images, levels: int) -> list[Images]:
    out = [a]
    for _ in range(levels - 1):
        out.append(_down(out[-1]))
    return out


def laplacian(vis: Images, ir: Images, levels: int = 4) -> Images:
    v, i = _pyramid(vis, levels), _pyramid(ir, levels)
    out = 0.5 * (v[-1] + i[-1])
    for k in range(levels - 2, -1, -1):
        a, b = v[k] - _up(v[k + 1], v[k]), i[k] - _up(i[k + 1], i[k])
        more = _taps(np.abs(a), filters.PYRAMID_TAPS, 0) >= _taps(np.abs(b), filters.PYRAMID_TAPS, 0)
        out = np.where(more, a, b) + _up(out, a)
    return clip01(out)


def ratio(vis: Images, ir: Images, levels: int = 4, eps: float = 1e-6) -> Images:
    v, i = _pyramid(vis, levels + 1), _pyramid(ir, levels + 1)
    out = 0.5 * (v[-1] + i[-1])
    for k in range(levels - 1, -1, -1):
        a, b = ((p[k] + eps) / (_up(p[k + 1], p[k]) + eps) for p in (v, i))
        out = np.where(np.abs(a - 1.0) >= np.abs(b - 1.0), a, b) * (_up(out, a) + eps)
    return clip01(out)


# --- wavelets
def _max_abs(a: Images, b: Images) -> Images:
    return np.where(np.abs(a) >= np.abs(b), a, b)


HAAR = {"A": (1, 1, 1, 1), "H": (1, 1, -1, -1), "V": (1, -1, 1, -1), "D": (1, -1, -1, 1)}


def _haar_split(a: Images) -> dict[str, Images]:
    a = np.pad(a, ((0, 0), (0, a.shape[1] % 2), (0, a.shape[2] % 2)), "edge")
    cell = (a[:, ::2, ::2], a[:, ::2, 1::2], a[:, 1::2, ::2], a[:, 1::2, 1::2])
    return {band: (s[0] * cell[0] + s[1] * cell[1] + s[2] * cell[2] + s[3] * cell[3]) / 2.0 for band, s in HAAR.items()}


def haar(vis: Images, ir: Images, levels: int = 3) -> Images:
    details, v, i = [], vis, ir
    for _ in range(levels):
        a, b = _haar_split(v), _haar_split(i)
        details.append({band: _max_abs(a[band], b[band]) for band in "HVD"})
        v, i = a["A"], b["A"]
    out = 0.5 * (v + i)
    for level in reversed(details):
        h, w = level["H"].shape[1:]
        a = out[:, :h, :w]
        out = np.empty((len(a), 2 * h, 2 * w))
        for dy in (0, 1):
            for dx in (0, 1):
                sh, sv = 1 - 2 * dy, 1 - 2 * dx
                out[:, dy::2, dx::2] = (a + sh * level["H"] + sv * level["V"] + sh * sv * level["D"]) / 2.0
    return clip01(out[:, : vis.shape[1], : vis.shape[2]])


def _analyse(a: Images, low: wavelets.Taps, axis: int) -> dict[str, Images]:
    """Half the places along an axis, low and high."""
    n, size = len(low), a.shape[axis]
    wide = np.moveaxis(_along(a, axis, _mirrored(size, n - 1, 1)), axis, -1)  # its place p is p - (n - 1)
    at = np.arange(1, size + n - 1, 2)
    out = {}
    for half, taps in wavelets._filters(low).items():
        total = 0.0
        for j, t in enumerate(taps):
            if t:
                total = total + t * wide[..., at + j]
        out[half] = np.moveaxis(total, -1, axis)
    return out


def _synthesise(parts: dict[str, Images], low: wavelets.Taps, axis: int) -> Images:
    n = len(low)
    moved = {half: np.moveaxis(a, axis, -1) for half, a in parts.items()}
    size = moved["L"].shape[-1] - (n // 2 - 1)
    out = np.empty((*moved["L"].shape[:-1], 2 * size))
    for odd in (0, 1):
        total = 0.0
        for half, taps in wavelets._filters(low).items():
            for i in range(n // 2):
                if taps[2 * i + odd]:
                    at = n // 2 - 1 - i
                    total = total + taps[2 * i + odd] * moved[half][..., at : at + size]
        out[..., odd::2] = total
    return np.moveaxis(out, -1, axis)


def _split(a: Images, low_x: wavelets.Taps, low_y: wavelets.Taps) -> dict[str, Images]:
    return {h + g: b for h, half in _analyse(a, low_x, 2).items() for g, b in _analyse(half, low_y, 1).items()}


def _join(bands: dict[str, Images], low_x: wavelets.Taps, low_y: wavelets.Taps) -> Images:
    h, w = (min(b.shape[k] for b in bands.values()) for k in (1, 2))
    bands = {name: b[:, :h, :w] for name, b in bands.items()}
    return _synthesise({h: _synthesise({g: bands[h + g] for g in "LH"}, low_y, 1) for h in "LH"}, low_x, 2)


def db4(vis: Images, ir: Images, levels: int = 3) -> Images:
    details, v, i = [], vis, ir
    for _ in range(levels):
        a, b = _split(v, wavelets.DB4, wavelets.DB4), _split(i, wavelets.DB4, wavelets.DB4)
        details.append({band: _max_abs(a[band], b[band]) for band in wavelets.BANDS[1:]})
        v, i = a["LL"], b["LL"]
    out = 0.5 * (v + i)
    for level in reversed(details):
        out = _join({"LL": out, **level}, wavelets.DB4, wavelets.DB4)
    return clip01(out[:, : vis.shape[1], : vis.shape[2]])


def dual_tree(vis: Images, ir: Images, levels: int = 4) -> Images:
    first, bank = (dict(zip("ab", x)) for x in ((wavelets.FIRST_A, wavelets.FIRST_B), (wavelets.QUARTER_A, wavelets.QUARTER_B)))
    details, v, i = [], dict.fromkeys(wavelets.TREES, vis), dict.fromkeys(wavelets.TREES, ir)
    for k in range(levels):
        low = bank if k else first
        a, b = ({t: _split(s[t], low[t[0]], low[t[1]]) for t in wavelets.TREES} for s in (v, i))
        level = {t: {} for t in wavelets.TREES}
        for band in wavelets.BANDS[1:]:
            pick = {}
            for sign in (1, -1):
                (rv, iv), (ri, ii) = ((s["aa"][band] - sign * s["bb"][band], s["ab"][band] + sign * s["ba"][band]) for s in (a, b))
                wins = rv * rv + iv * iv >= ri * ri + ii * ii
                pick[sign] = np.where(wins, rv, ri), np.where(wins, iv, ii)
            level["aa"][band], level["bb"][band] = (pick[1][0] + pick[-1][0]) / 2.0, (pick[-1][0] - pick[1][0]) / 2.0
            level["ab"][band], level["ba"][band] = (pick[1][1] + pick[-1][1]) / 2.0, (pick[1][1] - pick[-1][1]) / 2.0
        details.append(level)
        v, i = ({t: s[t]["LL"] for t in wavelets.TREES} for s in (a, b))
    out = {t: 0.5 * (v[t] + i[t]) for t in wavelets.TREES}
    for k in range(levels - 1, -1, -1):
        low = bank if k else first
        out = {t: _join({"LL": out[t], **details[k][t]}, low[t[0]], low[t[1]]) for t in wavelets.TREES}
    return clip01(sum((out[t] for t in wavelets.TREES), 0.0)[:, : vis.shape[1], : vis.shape[2]] / 4.0)


# --- metrics
def _sum(a: Images) -> np.ndarray:
    return a.reshape(len(a), -1).sum(1)


def _mean(a: Images) -> np.ndarray:
    return _sum(a) / a[0].size if a[0].size else np.full(len(a), np.nan)


def _number(a: Images) -> np.ndarray:
    """At each pixel the number of its image."""
    return np.broadcast_to(np.arange(len(a)).reshape(-1, 1, 1), a.shape)


def _entropy(a: Images, bins: int = 256, floor: float = 1e-12) -> np.ndarray:
    inside = (a >= 0) & (a <= 1)
    b = np.minimum(np.floor(np.where(inside, a, 0.0) * float(bins)), bins - 1).astype(np.int64)
    n = np.bincount((_number(a) * bins + b)[inside], minlength=len(a) * bins).reshape(len(a), bins)
    total = 1.0 + bins * floor
    every = n.sum(1)
    q = (n / every[:, None] + floor) / total
    out = np.where(n > 0, -q * np.log2(q), 0.0).sum(1) - (bins - (n > 0).sum(1)) * (floor / total) * math.log2(floor / total)
    return np.where(every > 0, out, np.nan)


def _same(codes: np.ndarray) -> np.ndarray:
    """At each place how many have the same code."""
    _, at, n = np.unique(codes.reshape(-1), return_inverse=True, return_counts=True)
    return n[at].reshape(codes.shape).astype(float)


def _information(a: Images, b: Images, bins: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mutual information and both entropies."""
    la, lb = (np.floor(clip01(v) * float(bins - 1)).astype(np.int64) for v in (a, b))
    image, every = _number(a), float(a[0].size)
    na, nb, nab = _same(image * bins + la), _same(image * bins + lb), _same((image * bins + la) * bins + lb)
    return _mean(np.log2(nab * every / (na * nb))), _mean(-np.log2(na / every)), _mean(-np.log2(nb / every))


def _sobel(a: Images) -> tuple[Images, Images]:
    def sides(v: Images, axis: int) -> tuple[Images, Images]:
        at = np.arange(v.shape[axis])
        return _along(v, axis, np.maximum(at - 1, 0)), _along(v, axis, np.minimum(at + 1, len(at) - 1))

    left, right = sides(a, 2)
    d, s = right - left, left + 2 * a + right
    (du, dd), (su, sd) = sides(d, 1), sides(s, 1)
    gx, gy = du + 2 * d + dd, sd - su
    return np.sqrt(gx * gx + gy * gy), np.where(gx == 0, math.pi / 2, np.arctan(gy / -gx))


def _preserved(src: tuple[Images, Images], own: tuple[Images, Images]) -> Images:
    (gs, at), (gf, af) = src, own
    strength = np.where(gs > gf, gf / (gs + 1e-12), np.where(gs < gf, gs / (gf + 1e-12), gf))
    angle = 1.0 - np.abs(at - af) / 1.5707963267948966
    return (0.9994 / (1.0 + np.exp(-15.0 * (strength - 0.5)))) * (0.9879 / (1.0 + np.exp(-22.0 * (angle - 0.8))))


def _slope(a: Images) -> Images:
    """Length of the central-difference gradient, one-sided at the border."""
    parts = []
    for axis in (2, 1):
        size, at = a.shape[axis], np.arange(a.shape[axis])
        lo, hi = np.maximum(at - 1, 0), np.minimum(at + 1, size - 1)
        step = np.where(hi - lo == 2, 2.0, 1.0).reshape([-1 if k == axis else 1 for k in range(3)])
        parts.append((_along(a, axis, hi) - _along(a, axis, lo)) / step)
    return np.sqrt(parts[0] * parts[0] + parts[1] * parts[1])


def _local(f: Images, vis: Images, ir: Images) -> tuple[Images, Images, dict[str, Images]]:
    """The quality index at a place, its saliency, and the local means of the images and their products."""
    v = {"f": f, "vis": vis, "ir": ir}
    m = v | {f"{c}_{c}": x * x for c, x in v.items()} | {f"f_{s}": f * v[s] for s in ("vis", "ir")}
    m = {name: _taps(a, filters.box_taps(7), 1) for name, a in m.items()}
    var = {c: np.maximum(m[f"{c}_{c}"] - m[c] * m[c], 0.0) for c in v}

    def q(s: str) -> Images:
        x, own = m[s], m["f"]
        den = (var[s] + var["f"]) * (x * x + own * own)
        return np.where(den > 1e-12, 4.0 * (m[f"f_{s}"] - x * own) * x * own / den, 1.0)

    share = var["vis"] / (var["vis"] + var["ir"] + 1e-12)
    return share * q("vis") + (1.0 - share) * q("ir"), np.maximum(var["vis"], var["ir"]), m


def _similar(m: dict[str, Images], s: str, scale: float) -> Images:
    c1, c2 = 0.01**2, 0.03**2
    f, x = m["f"], m[s]
    vf, vx, cov = ((m[n] - p) * scale for n, p in (("f_f", f * f), (f"{s}_{s}", x * x), (f"f_{s}", f * x)))
    return ((2 * f * x + c1) * (2 * cov + c2)) / ((f * f + x * x + c1) * (vf + vx + c2))


def _correlation(a: Images, b: Images) -> np.ndarray:
    n = a[0].size
    da, db = a - _mean(a).reshape(-1, 1, 1), b - _mean(b).reshape(-1, 1, 1)
    return _mean(da * db) * n / (np.sqrt(_mean(da * da) * n * _mean(db * db) * n) + 1e-12)


def record(f: Images, vis: Images, ir: Images) -> dict[str, np.ndarray]:
    """Fifteen metrics of each image; NaN where an image is too small for one."""
    out = {"EN": _entropy(f), "SD": np.sqrt(_mean((f - _mean(f).reshape(-1, 1, 1)) ** 2))}
    out["FE"] = out["EN"] / ((_entropy(vis) + _entropy(ir)) / 2.0 + 1e-12)
    slopes = {"f": _slope(f), "vis": _slope(vis), "ir": _slope(ir)}
    out["MG"] = _mean(slopes["f"])
    out["MI_vis"], out["MI_ir"] = _information(f, vis)[0], _information(f, ir)[0]
    v = clip01(f) * 255.0
    dx, dy = v[:, :, 1:] - v[:, :, :-1], v[:, 1:] - v[:, :-1]
    out["SF"] = np.sqrt(_mean(dx * dx) + _mean(dy * dy))
    out["SCD"] = _correlation(f - ir, vis) + _correlation(f - vis, ir)
    g = {c: _sobel(a) for c, a in (("f", f), ("vis", vis), ("ir", ir))}
    gv, gi, gf = g["vis"][0], g["ir"][0], g["f"][0]
    qv, qi = _preserved(g["vis"], g["f"]), _preserved(g["ir"], g["f"])
    weight = _sum(gv + gi) + 1e-12
    out["Qabf"] = _sum(qv * gv + qi * gi) / weight
    out["Nabf"] = _sum(np.where((gf > gv) & (gf > gi), (1 - qv) * gv + (1 - qi) * gi, 0.0)) / weight
    edge = {}
    for c, e in slopes.items():
        lo, hi = (p(e, axis=(1, 2), keepdims=True) for p in (np.min, np.max))
        edge[c] = (e - lo) / (hi - lo + 1e-12)
    alike = []
    for s in ("vis", "ir"):
        mi, ha, hb = _information(edge["f"], edge[s])
        alike.append(np.where(ha + hb > 1e-12, 2 * mi / (ha + hb), 0.0))
    out["FMI"] = 0.5 * (alike[0] + alike[1])
    weighted = []
    for images in ((f, vis, ir), (edge["f"], edge["vis"], edge["ir"])):
        local, saliency, m = _local(*images)
        weighted.append(_sum(saliency * local) / (_sum(saliency) + 1e-12))
        if images[0] is f:
            out["Q0"] = _mean(local)
            # away from the border the same means are those of the similarity, which leaves the border out
            inner = {name: a[:, 3:-3, 3:-3] for name, a in m.items()}
            out["SSIM"] = 0.5 * (_mean(_similar(inner, "vis", 49 / 48)) + _mean(_similar(inner, "ir", 49 / 48)))
    out["QW"], out["QE"] = weighted[0], weighted[0] * weighted[1]
    return out
