"""Exact top-k by inner product with a pivot table.

Components become floor(scale * x). One more coordinate, sqrt(M - |c|^2) with M the largest squared
norm, gives all candidates the norm sqrt(M), and 0 to the query; then
|q - c|^2 = |q|^2 + M - 2 <q, c>, so the largest inner products are the nearest points of a metric
space. The pivot table (``measure``, written once) holds each candidate's distances to ``pivots`` candidates;
by the triangle inequality the largest |d(q, p) - d(c, p)| over the pivots bounds d(q, c) from below. A query
evaluates its candidates in the order of these bounds and stops at the first bound beyond its k-th best
distance so far: nothing after it can enter. Scores are integers and exact.

Pivots are far apart from one another (farthest first, among at most ``SAMPLE`` rows taken by hash). A row's
cell is its nearest pivot; a cell is dealt into blocks of about ``row_block`` rows. The pivots are candidates
themselves, so a query knows a radius before it meets any other: it goes only to the cells that the radius
can reach by the cells' least and largest distances to the pivots, and blocks of rows are sent only to the
blocks of queries that ask for them. Each pair of blocks is one group of bounded size, which yields k rows
for each query; these are merged by a grouped top-k. Vectors without any structure can't be pruned: then
every query meets every block, in bound order all the same.

Nulls: a vector that is null or holds a null or non-finite component takes no part; null ids take no part.
Vectors of different lengths meet as if the shorter one ended in zeros; a very long one is in blocks with
others of its length. Components beyond a long are its ends, as are scores beyond it; all else is exact,
whatever its size. Equal scores: the smaller id. Repeated ids: each row is a candidate and a query of its own;
a query's own rows (same id) never count. Fewer than k candidates: all of them. Empty table: empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS, SAMPLE, QUERY_BLOCK, ROW_BLOCK = 64, 2048, 1024, 16384
WIDE = 1 << 20
ENDS = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return v.select("id", F.transform("x", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64) if len(v) else np.empty((0, 0), np.int64)


def products(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both over their common length, as numbers whose inner products are exact: floats, longs or Python's integers."""
    w = min(c.shape[1], q.shape[1])
    c, q = c[:, :w], q[:, :w]
    most = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (c, q)]
    size = max(1, w) * most[0] * most[1]
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64 if size < 1 << 62 else object
    return c.astype(kind), q.astype(kind)


def largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, the least of them first."""
    return np.sort(x, axis=1)[:, -k:] if x.dtype == object else np.partition(x, x.shape[1] - k, axis=1)[:, -k:]


class Pivots:
    """far: distances of candidates to the pivots; to: of queries."""

    def __init__(self, points: list[np.ndarray], ids: list[int], top: float) -> None:
        self.ids, self.top = np.array(ids, np.int64), top
        self.x = np.zeros((len(points), max(map(len, points), default=0)))
        for i, p in enumerate(points):
            self.x[i, : len(p)] = p
        self.up = self.lift(self.x)
        self.slack = 1e-5 * (1 + np.sqrt(top))  # more than the rounding of distances

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1)))

    def dots(self, x: np.ndarray) -> np.ndarray:
        w = min(x.shape[1], self.x.shape[1])
        return x[:, :w] @ self.x[:, :w].T

    def far(self, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * (self.dots(c) + np.outer(self.lift(c), self.up)))).astype(np.float32)

    def to(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + self.top - 2 * self.dots(q))).astype(np.float32)

    @classmethod
    def spread(cls, points: list[np.ndarray], ids: list[int], top: float, n: int) -> Pivots:
        """The first, then each time the farthest from those taken."""
        every = cls(points, ids, top)
        taken, near = [], np.full(len(points), np.inf)
        while len(taken) < min(n, len(points)):
            i = int(near.argmax())
            taken.append(i)
            d = 2 * top - 2 * (every.x @ every.x[i] + every.up * every.up[i])
            near = np.minimum(near, d)
            near[taken] = -1.0
        return cls([points[i] for i in taken], [ids[i] for i in taken], top)


def search(frame: pd.DataFrame, queries: pd.DataFrame, pivots: Pivots, k: int, slab: int = 1 << 21) -> tuple[pd.DataFrame, int]:
    """The k best candidates of one block for each query of one block, and how many were evaluated.

    Queries go side by side, in slabs: all take their next batch of candidates, each in the order of its own bounds,
    until the next bound is beyond its radius.
    """
    c, q = products(stacked(frame["v"]), stacked(queries["v"]))
    least = np.iinfo(np.int64).min if c.dtype == np.int64 else -np.inf
    ids, q_ids, rows = frame["id"].to_numpy(), queries["id"].to_numpy(), queries["row"].to_numpy()
    columns = np.ascontiguousarray(np.stack(frame["far"].to_numpy()).T)
    to = np.stack(queries["to"].to_numpy())
    q_norm = (stacked(queries["v"]).astype(np.float64) ** 2).sum(1)
    out, evaluated, width = [], 0, max(1, slab // max(1, len(ids)))
    for lo in range(0, len(q), width):
        own = slice(lo, lo + width)
        n = len(q[own])
        bound = np.abs(columns[0] - to[own, :1])
        for p in range(1, len(columns)):
            np.maximum(bound, np.abs(columns[p] - to[own, p : p + 1]), out=bound)
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        scores = np.full(bound.shape, least, c.dtype)  # in the order of bounds; what isn't evaluated stays least
        best = np.full((n, k), least, c.dtype)
        radius = queries["radius"].to_numpy()[own] + pivots.slack
        at, step = 0, max(4 * k, 256)
        while at < len(ids) and len(live := np.flatnonzero(bound[:, at] <= radius)):
            pick = order[live, at : at + step]
            evaluated += pick.size
            found = np.matmul(c[pick], q[own][live][:, :, None])[:, :, 0]
            found[ids[pick] == q_ids[own][live][:, None]] = least
            scores[live, at : at + step] = found
            best[live] = largest(np.concatenate([best[live], found], axis=1), k)
            kth = best[live].min(axis=1).astype(np.float64)
            nearer = np.sqrt(np.maximum(0.0, q_norm[own][live] + pivots.top - 2 * kth)) + pivots.slack
            radius[live] = np.where(best[live].min(axis=1) > least, np.minimum(radius[live], nearer), radius[live])
            at, step = at + step, step * 2
        for i in range(n):
            some = np.flatnonzero((scores[i] >= best[i].min()) & (scores[i] > least))
            names, score = ids[order[i, some]], [int(s) for s in scores[i, some]]
            for j in sorted(range(len(some)), key=lambda j: (-score[j], names[j]))[:k]:
                out.append((rows[lo + i], q_ids[lo + i], names[j], min(max(score[j], ENDS[0]), ENDS[1])))
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"], dtype="int64"), evaluated


def measure(v: DataFrame, pivots: Pivots) -> DataFrame:
    """v with far, to and cell: the pivot table."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, same in pdf.groupby("dim"):
                x = stacked(same["v"]).astype(np.float64)
                far = pivots.far(x)
                yield same.assign(far=list(far), to=list(pivots.to(x)), cell=far.argmin(1).astype(np.int32))

    return v.mapInPandas(fill, v.schema.simpleString()[7:-1] + ",far:array<float>,to:array<float>,cell:int")


def reach(table: DataFrame, n: int) -> np.ndarray:
    """For each cell the least and the largest distance of its rows to each pivot: n x n x 2."""

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = np.full((n, n), np.inf, np.float32), np.full((n, n), -np.inf, np.float32)
        for pdf in frames:
            far, cell = np.stack(pdf["far"].to_numpy()), pdf["cell"].to_numpy()
            np.minimum.at(lo, cell, far)
            np.maximum.at(hi, cell, far)
        cells = np.flatnonzero(lo[:, 0] < np.inf)
        yield pd.DataFrame({"cell": np.repeat(cells, n), "p": np.tile(np.arange(n), len(cells)), "lo": lo[cells].ravel(), "hi": hi[cells].ravel()})

    found = table.select("far", "cell").mapInPandas(ranges, "cell int, p int, lo float, hi float")
    out = np.full((n, n, 2), np.inf)
    for r in found.groupBy("cell", "p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # n * n rows
        out[r["cell"], r["p"]] = r["lo"], r["hi"]
    return out


def ask(queries: DataFrame, pivots: Pivots, ranges: np.ndarray, k: int) -> DataFrame:
    """queries with radius, from the pivots as candidates, and cells: those that it reaches."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            to = np.stack(pdf["to"].to_numpy()).astype(np.float64)
            other = np.where(pivots.ids[None, :] == pdf["id"].to_numpy()[:, None], np.inf, to)
            radius = np.partition(other, k - 1, axis=1)[:, k - 1] if other.shape[1] >= k else np.full(len(to), np.inf)
            cells = []
            for d, r in zip(to, radius):
                below = np.maximum(ranges[:, :, 0] - d, d - ranges[:, :, 1]).max(1)
                cells.append(np.flatnonzero((below <= r + pivots.slack) & np.isfinite(ranges[:, 0, 0])).astype(np.int32))
            yield pdf.assign(radius=radius, cells=cells)

    return queries.mapInPandas(fill, queries.schema.simpleString()[7:-1] + ",radius:double,cells:array<int>")


def blocks(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, parts): into how many blocks the rows of these keys are dealt."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the column id."""
    found = candidates(vectors, is_query, k, id_col, vector_col, scale, pivots, query_block, row_block)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def candidates(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float, pivots: int, query_block: int, row_block: int) -> DataFrame:
    """The best of each pair of blocks: query_row, query_id, vec_id, score; and a row with the number evaluated."""
    schema = "query_row long, query_id long, vec_id long, score long, evaluated long"
    v = quantized(vectors, id_col, vector_col, scale)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = written(v.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), (size > WIDE).alias("wide"), norm.alias("norm"), F.coalesce(is_query, F.lit(False)).alias("query")))
    most = v.agg(F.max("norm").alias("norm"), F.max("dim").alias("dim")).first()
    if most["norm"] is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # a bounded number of numbers: rows by a hash of the id
    sample = v.orderBy(F.xxhash64("id"), "id", "row").limit(max(1, min(SAMPLE, (1 << 22) // max(1, most["dim"])))).select("id", "v").collect()
    table = Pivots.spread([np.array(r["v"], np.float64) for r in sample], [r["id"] for r in sample], float(most["norm"]), pivots)
    measured = written(measure(v.drop("norm"), table))
    own, theirs = ["dim", "wide", "cell"], ["q_dim", "q_wide"]
    part = lambda: F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    name = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    row_blocks = written(blocks(measured, own, row_block))
    rows = measured.join(row_blocks, own).withColumn("part", part()).select(name(*own, "part").alias("rb"), "id", "v", "far")
    asked = ask(measured.where("query").drop("far", "query", "cell"), table, reach(measured, len(table.ids)), k)
    asked = written(asked.withColumnsRenamed({"dim": "q_dim", "wide": "q_wide"}))
    asked = asked.join(blocks(asked, theirs, query_block), theirs).withColumn("q_part", part()).withColumn("qb", name(*theirs, "q_part"))
    asked = asked.drop("parts", "q_part", *theirs).withColumn("cell", F.explode("cells")).drop("cells").join(row_blocks, "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("qb", name(*own, "part").alias("rb"), "row", "id", "v", "to", "radius")
    rows = rows.join(asked.select("rb", F.col("qb").alias("for")).distinct(), "rb")

    def pair(asks: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(frame):
            return pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "score", "evaluated")}).astype("int64")
        best, n = search(frame, asks, table, k)
        return pd.concat([best.astype("Int64"), pd.DataFrame({"evaluated": [n]}, dtype="Int64")])

    return asked.groupBy("qb", "rb").cogroup(rows.groupBy("for", "rb")).applyInPandas(pair, schema)
