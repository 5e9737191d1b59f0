import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import wavelets

from .test_properties import image, noise, relation

BANKS = [(wavelets.FIRST_A, wavelets.FIRST_B), (wavelets.QUARTER_A, wavelets.QUARTER_B)]


def halves(low):
    n = len(low)
    return np.array(low), np.array([(-1) ** (n - j) * low[n - 1 - j] for j in range(n)])


def analyse(v, low, axis):
    """Both halves along an axis, place by place, the border mirrored with its edge."""
    v, n = np.moveaxis(v, axis, -1), len(low)
    size = v.shape[-1]
    at = np.array([[2 * k + 2 - n + j for j in range(n)] for k in range((size + n - 1) // 2)])
    at = np.mod(at, 2 * size)
    at = np.minimum(at, 2 * size - 1 - at)
    return [np.moveaxis(v[..., at] @ half, -1, axis) for half in halves(low)]


def synthesise(low_part, high_part, low, axis, size):
    a, b, n = np.moveaxis(low_part, axis, -1), np.moveaxis(high_part, axis, -1), len(low)
    out = np.zeros((*a.shape[:-1], 2 * a.shape[-1] + 2 * n))
    l, h = halves(low)
    for p, j in itertools.product(range(a.shape[-1]), range(n)):
        out[..., 2 * p + j] += l[j] * a[..., p] + h[j] * b[..., p]
    return np.moveaxis(out[..., n - 2 : n - 2 + size], -1, axis)


def bands_of(v, levels):
    """level -> tree -> band."""
    out, approx = [], {t: v for t in wavelets.TREES}
    for k in range(levels):
        bank = dict(zip("ab", BANKS[min(k, 1)]))
        level = {}
        for t in wavelets.TREES:
            halves_x = dict(zip("LH", analyse(approx[t], bank[t[0]], 1)))
            level[t] = {h + g: part for h in "LH" for g, part in zip("LH", analyse(halves_x[h], bank[t[1]], 0))}
            approx[t] = level[t]["LL"]
        out.append(level)
    return out


def fused_image(vis, ir, levels):
    both = [bands_of(v, levels) for v in (vis, ir)]
    sizes, f = [vis.shape, *[level["aa"]["LL"].shape for level in both[0]]], {t: (both[0][-1][t]["LL"] + both[1][-1][t]["LL"]) / 2 for t in wavelets.TREES}
    for k in range(levels - 1, -1, -1):
        bank, mixed = dict(zip("ab", BANKS[min(k, 1)])), {t: {} for t in wavelets.TREES}
        for b in ("LH", "HL", "HH"):
            z = []
            for level in (both[0][k], both[1][k]):
                aa, ab, ba, bb = (level[t][b] for t in wavelets.TREES)
                z.append(((aa - bb) + 1j * (ab + ba), (aa + bb) + 1j * (ab - ba)))
            plus, minus = (np.where(np.abs(z[0][i]) ** 2 >= np.abs(z[1][i]) ** 2, z[0][i], z[1][i]) for i in (0, 1))
            for t, part in zip(wavelets.TREES, ((plus + minus).real, (plus + minus).imag, (plus - minus).imag, (minus - plus).real)):
                mixed[t][b] = part / 2
        for t in wavelets.TREES:
            rows = [synthesise(*pair, bank[t[1]], 0, sizes[k][0]) for pair in ((f[t], mixed[t]["LH"]), (mixed[t]["HL"], mixed[t]["HH"]))]
            f[t] = synthesise(*rows, bank[t[0]], 1, sizes[k][1])
    return np.clip(sum(f.values()) / 4, 0, 1)


@pytest.mark.parametrize("shape", [(8, 8), (17, 12)])
def test_four_levels_equal_numpy(spark, shape):
    vis, ir = noise(31, shape), noise(32, shape)
    px = relation(spark, (vis, ir))
    want = bands_of(vis, 4)
    for k, level in enumerate(wavelets.dual_tree_bands(px, ["vis"], 4)):
        for t, b in itertools.product(wavelets.TREES, wavelets.BANDS):
            assert np.allclose(image(level, f"vis_{t}_{b}", want[k][t][b].shape), want[k][t][b])
    assert np.allclose(image(wavelets.dual_tree_fusion(px, 4), "f", shape), fused_image(vis, ir, 4))


def test_four_levels_keep_equal_sources_and_plan_fast(spark):
    v = noise(33, (16, 16))
    px = relation(spark, (v, v))
    fused = wavelets.dual_tree_fusion(px, 4)
    began = time.perf_counter()
    fused._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert np.allclose(image(fused, "f", v.shape), v, atol=1e-5)  # the quarter-shift taps have 8 digits


def test_stripes_are_told_apart(spark):
    """Each of six directions has a complex band of its own in which its stripes are the strongest."""
    y, x = np.mgrid[0:48, 0:48]
    angles = (15, 45, 75, 105, 135, 165)
    # in the middle of the second level's band: 0.18 along one axis, or along both for the diagonals
    stripes = [0.5 + 0.5 * np.cos(2 * np.pi * 0.18 * (2**0.5 if a % 90 == 45 else 1) * (x * np.cos(np.radians(a)) + y * np.sin(np.radians(a)))) for a in angles]
    level = wavelets.dual_tree_bands(relation(spark, *[(v, v) for v in stripes]), ["vis"], 2)[1]
    energy = np.zeros((len(angles), 6))
    for i, (b, sign) in enumerate(itertools.product(wavelets.BANDS[1:], (1, -1))):
        re, im = wavelets.directional("vis", b)[sign]
        for r in level.where("y BETWEEN 4 AND 12 AND x BETWEEN 4 AND 12").groupBy("pair_id").agg(F.sum(re * re + im * im).alias("e")).collect():
            energy[r["pair_id"], i] = r["e"]
    assert sorted(energy.argmax(axis=1)) == list(range(6))
    best = energy.max(axis=1)
    assert all(best > 1.5 * np.sort(energy, axis=1)[:, -2])
