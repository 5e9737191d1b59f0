"""Large images in tiles: a neighbourhood operator runs on each tile with a halo, and the halo is cut off again.

A pixel goes to its own tile and to those whose halo it lies in, as rows with tile keys; windows then partition by
(pair, tile), so one image is as many groups as it has tiles. What an operator makes of a tile's inner border is wrong up to
its reach, which the halo covers; at the image's own border a tile ends where the image does, so it is treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = ("_ty", "_tx")


def with_halo(px: DataFrame, size: int, halo: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """px with tile keys, each row once for every tile that holds it or has it in its halo; dealt by (keys, tile)."""
    if not 0 <= halo <= size:
        raise ValueError("a halo is at most as wide as a tile")

    def near(axis: str) -> Column:
        # a tile that this place alone would make, past the image, has no rows of its own and is cut off with the halo
        own = F.floor(F.col(axis) / size).cast("int")
        before, after = F.when(F.col(axis) % size < halo, own - 1), F.when(F.col(axis) % size >= size - halo, own + 1)
        return F.array_compact(F.array(own, F.when(before >= 0, before), after))

    for key, axis in zip(TILE, "yx"):
        px = px.withColumn(key, F.explode(near(axis)))
    return px.repartition(*keys, *TILE)


def tiled(px: DataFrame, operator: Callable[[DataFrame, tuple[str, ...]], DataFrame], size: int, halo: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """operator(px, keys) of the whole images, tile by tile; halo is how far the operator's result depends on its neighbours."""
    out = operator(with_halo(px, size, halo, keys), (*keys, *TILE))
    own = [F.floor(F.col(axis) / size).cast("int") == F.col(key) for key, axis in zip(TILE, "yx")]
    return out.where(own[0] & own[1]).drop(*TILE)
