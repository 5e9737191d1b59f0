"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(v: Column) -> Column:
    """v held to [0, 1]."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def to_byte(v: Column) -> Column:
    """[0, 1] to 0..255, truncated."""
    return F.floor(clip01(v) * 255.0).cast("int")


def from_byte(v: Column) -> Column:
    """0..255 to [0, 1]."""
    return v.cast("double") / 255.0


def rounded(v: Column, digits: int = 6) -> Column:
    """round() without a negative zero."""
    return F.round(v.cast("double"), digits) + F.lit(0.0)


def luma(blue: Column, green: Column, red: Column) -> Column:
    """Gray value of a BGR pixel; the weights are those of ITU-R BT.601."""
    return 0.114 * blue + 0.587 * green + 0.299 * red


def max_abs(a: Column, b: Column) -> Column:
    """The value farther from 0; a on a tie."""
    return F.when(F.abs(a) >= F.abs(b), a).otherwise(b)


def by_activity(act_a: Column, act_b: Column, a: Column, b: Column) -> Column:
    """The value with the larger activity; a on a tie."""
    return F.when(act_a >= act_b, a).otherwise(b)


def farthest_from_one(a: Column, b: Column) -> Column:
    """The ratio farther from 1; a on a tie."""
    return F.when(F.abs(a - 1.0) >= F.abs(b - 1.0), a).otherwise(b)


def level(v: Column, bins: int) -> Column:
    """Truncated level of a value for mutual information (M5)."""
    return F.floor(clip01(v) * float(bins - 1)).cast("int")


def edge_preservation(g_src: Column, a_src: Column, g_f: Column, a_f: Column) -> Column:
    """Sigmoid preservation of gradient strength and orientation. The constants are fixed values of the metric."""
    strength = F.when(g_src > g_f, g_f / (g_src + 1e-12)).when(g_src < g_f, g_src / (g_f + 1e-12)).otherwise(g_f)
    angle = 1.0 - F.abs(a_src - a_f) / F.lit(1.5707963267948966)
    return (0.9994 / (1.0 + F.exp(-15.0 * (strength - 0.5)))) * (0.9879 / (1.0 + F.exp(-22.0 * (angle - 0.8))))
