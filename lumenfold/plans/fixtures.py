"""The given tables in the shapes the operators work on: in Spark, and as DuckDB CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.morphology import co_partition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 pairs: vectors 2k (vis) and 2k + 1 (ir).

    Vectors are dealt by pair as they are and cut into pixels there: a place counts if two vectors of its pair have it, so the two
    longest tell all pixels, from the length of the third on.
    """
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"), "vec_id", (F.col("vec_id") % 2).alias("odd"), "embedding")
    e = e.withColumn("size", F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)))
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("size"), "vec_id"))).where("rn <= 3")
    of = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    two = e.groupBy("pair_id").agg(*[of(c, n).alias(f"{c}{n}") for n in (1, 2) for c in ("odd", "embedding")], of("size", 2).alias("end"), F.coalesce(of("size", 3), F.lit(0)).alias("from"))
    part = lambda n: F.slice(f"embedding{n}", F.col("from") + 1, F.col("end") - F.col("from")).alias(f"e{n}")
    two = two.where(F.col("end") > F.col("from")).select("pair_id", "from", "odd1", "odd2", F.posexplode(F.arrays_zip(part(1), part(2))).alias("at", "e"))
    v = lambda n: F.least(F.greatest(F.col(f"e.e{n}").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    one = lambda odd: F.greatest(*[F.when(F.col(f"odd{n}") == odd, v(n)) for n in (1, 2)])
    p = F.col("from") + F.col("at")
    px = two.select("pair_id", F.floor(p / 8).cast("int").alias("y"), (p % 8).cast("int").alias("x"), one(0).alias("vis"), one(1).alias("ir"))
    return co_partition(px)


PX = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS e FROM embeddings),
px AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS pair_id, CAST(floor(p / 8) AS INT) AS y, CAST(p % 8 AS INT) AS x,
  max(CASE WHEN vec_id % 2 = 0 THEN least(greatest(CAST(e AS DOUBLE) + 0.5, 0.0), 1.0) END) AS vis,
  max(CASE WHEN vec_id % 2 = 1 THEN least(greatest(CAST(e AS DOUBLE) + 0.5, 0.0), 1.0) END) AS ir
  FROM e GROUP BY 1, 2, 3 HAVING count(*) = 2)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 pairs, one per line number; empty cells are 0."""
    cell = [F.col("l_linenumber").cast("long").alias("pair_id"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")]
    c = table(spark, sf_dir, "lineitem").groupBy(*cell).agg((F.avg(F.col("l_quantity").cast("double")) / 50.0).alias("q"), (F.avg(F.col("l_discount").cast("double")) * 10.0).alias("d"))
    ids = spark.range(1, 8).select(F.col("id").alias("pair_id"))
    axis = lambda n: spark.range(64).select(F.col("id").cast("int").alias(n))
    grid = ids.crossJoin(axis("y")).crossJoin(axis("x"))  # 7 * 64 * 64 places, whatever the table's size
    v = lambda n: F.least(F.coalesce(F.col(n), F.lit(0.0)), F.lit(1.0))
    return co_partition(grid.join(c, ["pair_id", "y", "x"], "left").select("pair_id", "y", "x", v("q").alias("vis"), v("d").alias("ir")))


RASTER = """cells AS (SELECT l_linenumber AS pair_id, CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
  avg(CAST(l_quantity AS DOUBLE)) / 50.0 AS q, avg(CAST(l_discount AS DOUBLE)) * 10.0 AS d FROM lineitem GROUP BY 1, 2, 3),
grid AS (SELECT CAST(p.range AS BIGINT) AS pair_id, CAST(y.range AS INT) AS y, CAST(x.range AS INT) AS x FROM range(1, 8) p, range(64) y, range(64) x),
px AS (SELECT g.pair_id, g.y, g.x, CAST(least(coalesce(q, 0.0), 1.0) AS DOUBLE) AS vis, CAST(least(coalesce(d, 0.0), 1.0) AS DOUBLE) AS ir
  FROM grid g LEFT JOIN cells c ON g.pair_id = c.pair_id AND g.y = c.y AND g.x = c.x)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 subjects x 5 treatments, four metrics, wide."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice").cast("double")
    return o.groupBy(F.col("c_nationkey").cast("long").alias("subject"), F.col("o_orderpriority").alias("treatment")).agg(
        F.avg(price).alias("price_mean"), F.stddev_pop(price).alias("price_sd"), F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)).alias("open_rate"),
    )


MEASURES = """wide AS (SELECT CAST(c_nationkey AS BIGINT) AS subject, o_orderpriority AS treatment, avg(CAST(o_totalprice AS DOUBLE)) AS price_mean,
  stddev_pop(CAST(o_totalprice AS DOUBLE)) AS price_sd, CAST(count(*) AS DOUBLE) AS n_orders,
  avg(CASE WHEN o_orderstatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS open_rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def many_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many subjects as suppliers x 5 treatments, four metrics, wide."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = lambda c: F.round(F.avg(F.col(c).cast("double")), 10)  # noqa: E731  ties must not hang on the order of a sum
    return li.groupBy(F.col("l_suppkey").cast("long").alias("subject"), F.col("o_orderpriority").alias("treatment")).agg(
        d("l_quantity").alias("qty"), d("l_extendedprice").alias("price"), d("l_discount").alias("disc"), d("l_tax").alias("tax")
    )


MANY = """wide AS (SELECT CAST(l_suppkey AS BIGINT) AS subject, o_orderpriority AS treatment, round(avg(CAST(l_quantity AS DOUBLE)), 10) AS qty,
  round(avg(CAST(l_extendedprice AS DOUBLE)), 10) AS price, round(avg(CAST(l_discount AS DOUBLE)), 10) AS disc, round(avg(CAST(l_tax AS DOUBLE)), 10) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth boxes: image_id, class_id, box_id, cx, cy, w, h; one for each lineitem row."""
    d = lambda c: F.col(c).cast("double")
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 6).cast("int").alias("class_id"), F.col("l_partkey").alias("box_id"),
        (0.1 + 0.8 * (F.col("l_partkey") % 97) / 96.0).alias("cx"), (0.1 + 0.8 * (F.col("l_suppkey") % 89) / 88.0).alias("cy"),
        (0.02 + d("l_quantity") / 500.0).alias("w"), (0.02 + d("l_discount")).alias("h"),
    )


GT = """gt AS (SELECT l_orderkey AS image_id, CAST(l_linenumber % 6 AS INT) AS class_id, l_partkey AS box_id,
  CAST(0.1 AS DOUBLE) + CAST(0.8 AS DOUBLE) * (l_partkey % 97) / CAST(96.0 AS DOUBLE) AS cx, CAST(0.1 AS DOUBLE) + CAST(0.8 AS DOUBLE) * (l_suppkey % 89) / CAST(88.0 AS DOUBLE) AS cy,
  CAST(0.02 AS DOUBLE) + CAST(l_quantity AS DOUBLE) / CAST(500.0 AS DOUBLE) AS w, CAST(0.02 AS DOUBLE) + CAST(l_discount AS DOUBLE) AS h FROM lineitem)"""

#: Fixed parameters of the made-up detectors: name -> k.
DETECTORS = {"VIS": 3, "IR": 5, "FUSED": 11}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes of three detectors: method, image_id, class_id, box_id, cx, cy, w, h, conf."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(k).alias("k")) for n, k in DETECTORS.items()]))
    p = truth(spark, sf_dir).withColumn("m", m).select("*", "m.*")
    p = p.where((F.col("box_id") + F.col("image_id")) % F.col("k") != 0)
    cx = F.col("cx") + ((F.col("box_id") * F.col("k")) % 7 - 3) * 0.004
    conf = ((F.col("box_id") * 31 + F.col("image_id") * 17 + F.col("k") * 7) % 1000) / 1000.0
    return p.select("method", "image_id", "class_id", "box_id", cx.alias("cx"), "cy", "w", "h", conf.alias("conf"))


PRED = """pred AS (SELECT m.method, g.image_id, g.class_id, g.box_id, g.cx + ((g.box_id * m.k) % 7 - 3) * CAST(0.004 AS DOUBLE) AS cx, g.cy, g.w, g.h,
  ((g.box_id * 31 + g.image_id * 17 + m.k * 7) % 1000) / CAST(1000.0 AS DOUBLE) AS conf
  FROM gt g CROSS JOIN (SELECT 'VIS' AS method, 3 AS k UNION ALL SELECT 'IR', 5 UNION ALL SELECT 'FUSED', 11) m WHERE (g.box_id + g.image_id) % m.k <> 0)"""

#: Classes in order; the last one isn't a known name.
NAMES = ("People", "Car", "Bus", "Motorcycle", "Lamp")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, xml: one annotation per image with integer corners on 1024 x 768."""
    names = F.array(*[F.lit(n) for n in (*NAMES, "Other")])
    corner = lambda c, s, sign, size: F.floor((F.col(c) + sign * F.col(s) / 2.0) * size).cast("int")
    obj = F.format_string(
        "<object><name>%s</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>",
        F.element_at(names, F.col("class_id") + 1), corner("cx", "w", -1, 1024.0), corner("cy", "h", -1, 768.0), corner("cx", "w", 1, 1024.0), corner("cy", "h", 1, 768.0),
    )
    xml = F.concat(F.lit("<annotation><size><width>1024</width><height>768</height></size>"), F.concat_ws("", F.sort_array(F.collect_list(obj))), F.lit("</annotation>"))
    return truth(spark, sf_dir).groupBy("image_id").agg(xml.alias("xml"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, path: a listing of image and label files made from the parts."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key.cast("string"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".png", ".BMP", ".jpg", ".txt")]), (key % 4 + 1).cast("int"))
    row = lambda on, folder, end: F.when(on, F.struct(F.lit(folder).alias("folder"), F.concat(F.lit(folder + "/"), stem, end).alias("path")))
    rows = F.array_compact(F.array(row(F.lit(True), "VIS", ext), row(key % 10 != 3, "IR", ext), row(key % 7 != 2, "LABEL", F.lit(".xml"))))
    return p.select(F.explode(rows).alias("r")).select("r.folder", "r.path")


FILES = """stems AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, ['.png', '.BMP', '.jpg', '.txt'][p_partkey % 4 + 1] AS ext FROM part),
files AS (SELECT 'VIS' AS folder, 'VIS/' || stem || ext AS path FROM stems UNION ALL SELECT 'IR', 'IR/' || stem || ext FROM stems WHERE k % 10 <> 3
  UNION ALL SELECT 'LABEL', 'LABEL/' || stem || '.xml' FROM stems WHERE k % 7 <> 2)"""


def sweep_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, iter, particle, r, m, fit from the events."""
    from pyspark.sql import Window

    config = (F.col("user_id") % 25).cast("long")
    e = table(spark, sf_dir, "events").withColumn("config", config)
    it = F.row_number().over(Window.partitionBy("config").orderBy("ts", "event_id"))
    return e.select("config", it.alias("iter"), F.col("event_id").alias("particle"), (1.0 + F.col("event_id") % 25).alias("r"), (0.05 + (F.col("event_id") % 116) / 100.0).alias("m"), F.col("value").cast("double").alias("fit"))


PSO = """pso AS (SELECT CAST(user_id % 25 AS BIGINT) AS config, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS iter, event_id AS particle,
  CAST(1 AS DOUBLE) + event_id % 25 AS r, CAST(0.05 AS DOUBLE) + (event_id % 116) / CAST(100 AS DOUBLE) AS m, CAST(value AS DOUBLE) AS fit FROM events)"""
