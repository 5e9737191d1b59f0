"""Search over the two fusion parameters (r, m): all candidates of a generation in one job, state in tables.

Top-hats depend on r only and m is a projection over them, so candidates that share a rounded r share their
windows, and all candidates share what is measured of the sources (``SourceStore``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip01
from ..sources.staging import exists, staged
from . import metrics, morphology

KEYS = ("candidate", "pair_id")
#: Fixed values of the search: bounds of r and m, inertia from the first to the last round, pulls.
BOUNDS = {"r": (1.0, 25.0), "m": (0.05, 1.2)}
W_MAX, W_MIN, C1, C2 = 0.9, 0.4, 1.5, 1.5
STATE = ("config", "n", "rounds", "particle", "r", "m", "vr", "vm", "best_fit", "best_r", "best_m", "top_fit", "top_r", "top_m")


def clipped(candidates: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """candidates (candidate, r, m) held to the bounds, r rounded half to even (O1)."""
    b = bounds or BOUNDS
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(b[c][0])), F.lit(b[c][1]))
    return candidates.select("candidate", F.bround(held("r"), 0).cast("int").alias("r"), held("m").alias("m"))


def _image(m: Column) -> Column:
    return clip01(0.5 * (F.col("vis") + F.col("ir")) + m * F.col("_w") - m * F.col("_b"))


def _details(px: DataFrame, r: int, classic: bool) -> DataFrame:
    """px with the larger bright and dark details _w and _b of the sources."""
    hats = morphology.top_hats(px, ["vis", "ir"], "disk", r) if classic else morphology.combined_top_hats(px, ["vis", "ir"], r)
    hats = hats.withColumns({"_w": F.greatest("vis_wth", "ir_wth"), "_b": F.greatest("vis_bth", "ir_bth")})
    return hats.drop(*[f"{s}_{k}" for s in ("vis", "ir") for k in ("wth", "bth")])


def fused_candidates(px: DataFrame, candidates: DataFrame, radii: list[int], classic: bool = False) -> DataFrame:
    """candidate, pair_id, y, x, vis, ir, f, row by row: the plain form of what ``SourceStore`` measures."""
    parts = []
    for r in radii:
        own = candidates.where(F.col("r") == r).agg(F.collect_list(F.struct("candidate", "m")).alias("_own"))  # one row: a generation's candidates
        parts.append(_details(px, r, classic).crossJoin(F.broadcast(own)).withColumn("_c", F.explode("_own")))
    return reduce(DataFrame.unionByName, parts).select("_c.candidate", "pair_id", "y", "x", "vis", "ir", _image(F.col("_c.m")).alias("f"))


class SourceStore:
    """What the search needs of the pairs, worked out once and kept as tables in buckets by pair (O3).

    One table holds the sources with their gradients and local moments; one for each radius and operator, made when it is first
    asked for, has the top-hats beside them. A candidate is then a projection of its radius' table: no join and no shuffle.
    Candidates of a radius go side by side, ``WIDTH`` images as columns of the same pixels, so a sort, a window and a
    scan serve all of them. The store lives as long as the sweep: each generation asks for what it needs.
    """

    WIDTH = 4

    def __init__(self, px: DataFrame):
        self.features = staged(metrics.source_features(px))
        self.hats: dict[tuple[int, bool], DataFrame] = {}

    def of_radius(self, r: int, classic: bool = False) -> DataFrame:
        if (r, classic) not in self.hats:
            self.hats[r, classic] = staged(_details(self.features, r, classic))
        return self.hats[r, classic]

    def measures(self, candidates: DataFrame, classic: bool = False, edges: bool = True, information: bool = True) -> DataFrame:
        """candidate, pair_id and the measures (of ``metrics.fast_columns``; with information also en, the entropy in bits)."""
        slots = F.row_number().over(Window.partitionBy("r").orderBy("candidate")) - 1
        c = candidates.withColumn("_n", slots).withColumns({"chunk": F.floor(F.col("_n") / self.WIDTH).cast("int"), "slot": (F.col("_n") % self.WIDTH).cast("int")})
        c = staged(c.drop("_n"), ("r",))  # the candidates of one generation
        parts = []
        for row in c.groupBy("r").agg((F.max("slot") + 1).alias("width")).orderBy("r").collect():  # 25 radii at most
            own = c.where(F.col("r") == row["r"])
            chunks = own.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("_m"))
            images = [f"_f{i}" for i in range(row["width"])]
            px = self.of_radius(row["r"], classic).crossJoin(F.broadcast(chunks))  # a generation's candidates, some numbers each
            px = px.withColumns({f: _image(F.col("_m")[i]) for i, f in enumerate(images)}).drop("_m", "_w", "_b")
            keys = ("chunk", "pair_id")
            found = metrics.fast_columns(px, images, keys, edges).select(*keys, F.posexplode("measures").alias("slot", "_v")).select(*keys, "slot", "_v.*")
            if information:
                values = px.select(*keys, F.posexplode(F.array(*images)).alias("slot", "f"))
                en = metrics.entropy(values, "f", floor=0.0, keys=(*keys, "slot")).withColumnRenamed("value", "en")
                found = found.join(en, [*keys, "slot"])
            parts.append(found.join(F.broadcast(own.select("candidate", "chunk", "slot")), ["chunk", "slot"]).drop("chunk", "slot"))
        return reduce(DataFrame.unionByName, parts)

    def fitnesses(self, candidates: DataFrame, classic: bool = False, edges: bool = True, information: bool = True) -> DataFrame:
        """candidate, edges, information (or one of them): the objectives over all pairs (O1, O2)."""
        out = {}
        if edges:
            out["edges"] = F.avg(F.col("ssim") + F.col("qabf") + 0.5 * F.col("scd") - F.col("nabf"))
        if information:
            out["information"] = F.avg(F.col("ssim") + F.col("en") / 8.0 + F.col("psnr"))
        return self.measures(candidates, classic, edges, information).groupBy("candidate").agg(*[v.alias(n) for n, v in out.items()])

    def fitness(self, kind: str, classic: bool = False) -> Callable[[DataFrame], DataFrame]:
        """The fitness "edges" or "information" as a function of candidates, as ``run`` takes it."""
        return lambda candidates: self.fitnesses(candidates, classic, kind == "edges", kind == "information").withColumnRenamed(kind, "fitness")


def fitness_edges(fused: DataFrame) -> DataFrame:
    """candidate, fitness: mean over scenes of similarity + Qabf + half of SCD - Nabf (O1)."""
    return both_fitnesses(fused, information=False).withColumnRenamed("edges", "fitness")


def fitness_information(fused: DataFrame) -> DataFrame:
    """candidate, fitness: mean over scenes of similarity + entropy / 8 + PSNR / 100 (O2)."""
    return both_fitnesses(fused, edges=False).withColumnRenamed("information", "fitness")


def both_fitnesses(fused: DataFrame, edges: bool = True, information: bool = True) -> DataFrame:
    """candidate, edges, information (or one of them): both objectives from one pass over the candidates' pixels (O3)."""
    out = {}
    if edges:
        out["edges"] = F.avg(F.col("ssim") + F.col("qabf") + 0.5 * F.col("scd") - F.col("nabf"))
    if information:
        out["information"] = F.avg(F.col("ssim") + F.col("en") / 8.0 + F.col("psnr"))
    measured = metrics.fast_pass(fused, KEYS, edges, information)
    return measured.groupBy("candidate").agg(*[v.alias(n) for n, v in out.items()])


def configurations(swarms: list[int], rounds: list[int], spark) -> DataFrame:
    """n, rounds of every configuration."""
    a = spark.createDataFrame([(n,) for n in swarms], "n int")
    return a.crossJoin(spark.createDataFrame([(t,) for t in rounds], "rounds int"))


Draw = Callable[[int], Column]


def hashed(salt: int) -> Draw:
    """Uniform numbers of [0, 1) by a hash of configuration, particle and salt."""
    return lambda more: F.pmod(F.xxhash64("config", "particle", F.lit(salt + more)), F.lit(1 << 40)) / float(1 << 40)


def particles(configs: DataFrame, seed: int = 1000, draws: Callable[[int], Draw] = hashed) -> DataFrame:
    """The first generation of every configuration: config, n, rounds, particle, r, m, vr, vm, uniform by draws."""
    u = draws(seed)
    p = configs.withColumn("config", F.concat_ws("x", "n", "rounds")).withColumn("particle", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = {c: lo + (hi - lo) * u(i) for i, (c, (lo, hi)) in enumerate(BOUNDS.items())}
    return p.withColumns({**at, "vr": -0.3 + 0.6 * u(2), "vm": -0.3 + 0.6 * u(3)})


def step(state: DataFrame, t: Column) -> DataFrame:
    """The next generation from state (config, particle, rounds, r, m, vr, vm, fit, best_fit, best_r, best_m, u1, u2), u1 and u2 the random draws.

    A better value replaces a particle's best only if it is strictly larger; the configuration's best is the
    largest, the first particle's on a tie. All draws are columns, so a step is a projection and one window.
    """
    better = F.col("fit") > F.coalesce("best_fit", F.lit(float("-inf")))
    s = state.withColumns({"_f": F.when(better, F.col("fit")).otherwise(F.col("best_fit")), "_r": F.when(better, F.col("r")).otherwise(F.col("best_r")), "_m": F.when(better, F.col("m")).otherwise(F.col("best_m"))})
    top = F.min(F.struct((-F.col("_f")).alias("less"), "particle", "_r", "_m")).over(Window.partitionBy("config"))
    s = s.withColumn("_top", top)
    w = W_MAX - (W_MAX - W_MIN) * t / F.greatest(F.lit(1), F.col("rounds") - 1)
    v = {c: w * F.col(f"v{c}") + C1 * F.col(f"u1{c}") * (F.col(f"_{c}") - F.col(c)) + C2 * F.col(f"u2{c}") * (F.col(f"_top._{c}") - F.col(c)) for c in "rm"}
    s = s.withColumns({f"_v{c}": x for c, x in v.items()})
    held = lambda c: F.least(F.greatest(F.col(c) + F.col(f"_v{c}"), F.lit(BOUNDS[c][0])), F.lit(BOUNDS[c][1]))
    return s.select(
        "config", "n", "rounds", "particle", held("r").alias("r"), held("m").alias("m"), F.col("_vr").alias("vr"), F.col("_vm").alias("vm"),
        F.col("_f").alias("best_fit"), F.col("_r").alias("best_r"), F.col("_m").alias("best_m"), (-F.col("_top.less")).alias("top_fit"), F.col("_top._r").alias("top_r"), F.col("_top._m").alias("top_m"),
    )


class Generations:
    """The state and the history of a run, a Parquet folder for each generation, in a folder that all executors share.

    A generation is there once its folder has the marker that a committed write leaves; a folder without one, as a run leaves it
    that is ended while writing, is written anew.
    """

    STATE = "config string, n int, rounds int, particle int, r double, m double, vr double, vm double, best_fit double, best_r double, best_m double, top_fit double, top_r double, top_m double"
    HISTORY = "config string, iter int, particle int, r double, m double, fit double"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, what: str, rows: DataFrame, t: int) -> DataFrame:
        schema = self.STATE if what == "state" else self.HISTORY
        names = [c.split()[0] for c in schema.split(", ")]
        rows.select(*[F.col(c) for c in names]).write.mode("overwrite").parquet(f"{self.folder}/{what}/t={t}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/t={t}")

    def last(self) -> tuple[DataFrame, int] | None:
        """The last state of an unbroken row of complete ones, and its number."""
        t = -1
        while exists(self.spark, f"{self.folder}/state/t={t + 1}/_SUCCESS"):
            t += 1
        return None if t < 0 else (self.spark.read.schema(self.STATE).parquet(f"{self.folder}/state/t={t}"), t)

    def history(self) -> DataFrame:
        """config, iter, particle, r, m, fit: every evaluation, r and m as evaluated."""
        return self.spark.read.schema(self.HISTORY).parquet(f"{self.folder}/history/*")


def run(configs: DataFrame, fitness: Callable[[DataFrame], DataFrame], generations: int, kept: Generations, seed: int = 7000, draws: Callable[[int], Draw] = hashed) -> DataFrame:
    """All swarms side by side, a Spark job a generation (O5); goes on after the last generation that kept has.

    fitness: of held candidates (candidate, r, m) to (candidate, fitness), such as ``SourceStore.fitness`` gives. Every
    generation's evaluations are kept before the state that follows from them. Swarms whose rounds are over stay as they are.
    """
    empty = {f"{who}_{c}": F.lit(None).cast("double") for who in ("best", "top") for c in ("fit", "r", "m")}
    state, begin = kept.last() or (kept.keep("state", particles(configs, draws=draws).withColumns(empty), 0), 0)
    for t in range(begin, generations):
        live = state.where(F.col("rounds") > t).withColumn("candidate", F.concat_ws(":", "config", F.col("particle").cast("string")))
        held = clipped(live.select("candidate", "r", "m"))
        fit = fitness(held).withColumnRenamed("fitness", "fit")
        seen = live.select("candidate", "config", "particle").join(held.join(fit, "candidate"), "candidate")
        seen = kept.keep("history", seen.withColumns({"iter": F.lit(t + 1), "r": F.col("r").cast("double")}), t)
        u = draws(seed + 10 * t)
        known = live.drop("candidate").join(seen.select("config", "particle", "fit"), ["config", "particle"]).withColumns({"u1r": u(0), "u1m": u(1), "u2r": u(2), "u2m": u(3)})
        state = kept.keep("state", step(known, F.lit(t)).select(*STATE).unionByName(state.where(F.col("rounds") <= t)), t + 1)
    return state


def convergence(history: DataFrame) -> DataFrame:
    """config, iter, best so far."""
    w = Window.partitionBy("config").orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.select("config", "iter", F.max("fit").over(w).alias("best"))


def best_configuration(history: DataFrame) -> DataFrame:
    """config with its best evaluation, best first; the earliest on a tie."""
    top = F.min_by(F.struct("iter", "r", "m", "fit"), F.struct(-F.col("fit"), F.col("iter")))
    return history.groupBy("config").agg(top.alias("b")).select("config", "b.*").orderBy(F.desc("fit"), "config")


def to_resume(history: DataFrame, budget: int) -> DataFrame:
    """config, last, left: the last complete iteration of each configuration that has evaluations left."""
    last = history.groupBy("config").agg(F.max("iter").alias("last"))
    done = last.where(F.col("last") >= budget).select("config")
    return last.join(done, "config", "left_anti").select("config", "last", (F.lit(budget) - F.col("last")).alias("left"))
