"""File listings: matching by stem, nested discovery, splits, reorganisation. A listing is (folder, path) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

#: Image file endings (fixed values).
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The paths under a folder; file contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\A(.*?)(?:\.[^.]*)?\z", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)\z", 1))


def images(listing: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Rows with an allowed ending, whatever its case (P5)."""
    return listing.where(extension(F.col("path")).isin(*extensions))


def by_stem(listing: DataFrame, name: str) -> DataFrame:
    """stem and the smallest path with it, as <name>_path."""
    return listing.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias(f"{name}_path"))


def list_pairs(vis: DataFrame, ir: DataFrame) -> DataFrame:
    """Images of both listings with the same stem."""
    return by_stem(images(vis), "vis").join(by_stem(images(ir), "ir"), "stem").orderBy("stem")


def list_labelled(vis: DataFrame, ir: DataFrame, labels: DataFrame, required: bool = True) -> DataFrame:
    """vis images with their ir image, by name or else by stem, and their label; without one kept only if not required."""
    v = images(vis).select(stem(F.col("path")).alias("stem"), file_name(F.col("path")).alias("name"), F.col("path").alias("vis_path"))
    same_name = images(ir).groupBy(file_name(F.col("path")).alias("name")).agg(F.min("path").alias("_by_name"))
    v = v.join(same_name, "name", "left").join(by_stem(images(ir), "_ir"), "stem", "left")
    v = v.withColumn("ir_path", F.coalesce("_by_name", "_ir_path")).where("ir_path IS NOT NULL")
    return v.join(by_stem(labels, "label"), "stem", "inner" if required else "left").select("stem", "vis_path", "ir_path", "label_path")


def discover(listing: DataFrame, candidates: list[str]) -> DataFrame:
    """stem, path: of all files with a stem the one in the first candidate folder, else anywhere (S4). Folder names count without case."""
    lower = F.concat(F.lit("/"), F.lower("path"))
    rank = F.lit(len(candidates))
    for i, c in reversed(list(enumerate(candidates))):
        rank = F.when(lower.contains(f"/{c.lower()}/"), F.lit(i)).otherwise(rank)
    ranked = images(listing).withColumn("stem", stem(F.col("path")))
    best = F.min(F.struct(rank.alias("rank"), F.col("path").alias("path")))
    return ranked.groupBy("stem").agg(best.alias("b")).select("stem", "b.path", "b.rank")


def with_split(listing: DataFrame, splits: tuple[str, ...] = ("train", "test", "val")) -> DataFrame:
    """listing with split, the folder of that name in the path; null in a flat listing."""
    return listing.withColumn("split", F.nullif(F.regexp_extract("path", rf"/({'|'.join(splits)})/", 1), F.lit("")))


def reorganise(listing: DataFrame, prefixes: tuple[str, ...] = ("VIS_", "IR_"), suffixes: tuple[str, ...] = ("_VIS", "_IR")) -> DataFrame:
    """directory, core, vis_path, ir_path, degenerate: in each directory the first ir file whose name contains the core of a vis file's.

    A file is vis or ir by the word in its name; one with both is both, and a pair of a file with itself is degenerate.
    """
    name = file_name(F.col("path"))
    d = listing.select(F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("directory"), "path", name.alias("name"), F.upper(name).alias("upper"))
    core = stem(F.col("path"))
    for end in (*[rf"\A\Q{p}\E" for p in prefixes], *[rf"\Q{s}\E\z" for s in suffixes]):
        core = F.regexp_replace(core, end, "")  # each step names the one before once: conditions on it would double the text every time
    vis = d.where(F.col("upper").contains("VIS")).select("directory", core.alias("core"), F.col("path").alias("vis_path"))
    ir = d.where(F.col("upper").contains("IR")).select("directory", F.col("path").alias("ir_path"), F.col("name").alias("ir_name"))
    match = containing(vis, ir, ["directory"], "core", "ir_name")
    first = match.groupBy("directory", "core", "vis_path").agg(F.min("ir_path").alias("ir_path"))
    return first.withColumn("degenerate", F.col("vis_path") == F.col("ir_path"))


def grams(text: Column, q: int | Column) -> Column:
    """The distinct runs of q characters of a text."""
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q if isinstance(q, Column) else F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(parts: DataFrame, names: DataFrame, keys: list[str], part: str, name: str, q: int = 4) -> DataFrame:
    """All rows of parts and names, equal in keys, where the name contains the part.

    The names' runs of characters are an index; a part asks it for the one of its own that the fewest names of its keys
    have, so it meets few names in vain. Runs have q characters; parts shorter than that ask for themselves (names are cut into the lengths that are asked
    for only), and an empty part, which every name contains, meets all names of its keys. A part with a run that no name has is in none.
    Runs are many times the rows they come from, which estimates by file size don't see: their joins are held to sorting, since a
    broadcast of them would pass through the driver.
    """
    n = F.length(part)
    asked = parts.where(n > 0).select(*keys, part).distinct()
    lengths = asked.agg(F.collect_set(F.least(n, F.lit(q))).alias("_lengths"))  # one row of at most q numbers
    asked = asked.withColumn("gram", F.explode(F.when(n < q, F.array(part)).otherwise(grams(F.col(part), q))))
    cut = F.explode(F.flatten(F.transform("_lengths", lambda k: grams(F.col(name), k))))
    index = names.crossJoin(F.broadcast(lengths)).withColumn("gram", cut).drop("_lengths")
    often = index.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("_often"))
    known = asked.hint("merge").join(often.hint("merge"), [*keys, "gram"], "left")
    rarest = known.groupBy(*keys, part).agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("often"), "gram")).alias("_rare")).where("_rare.often > 0")
    rarest = rarest.select(*keys, part, F.col("_rare.gram").alias("gram"))
    met = rarest.hint("merge").join(index.hint("merge"), [*keys, "gram"]).where(F.col(name).contains(F.col(part))).drop("gram")
    return parts.where(n > 0).hint("merge").join(met.hint("merge"), [*keys, part]).unionByName(parts.where(n == 0).hint("merge").join(names.hint("merge"), keys))


def batches(pairs: DataFrame, size: int, seed: int, key: str = "pair_id") -> DataFrame:
    """pairs with batch, in an order shuffled by a hash."""
    at = numbered(pairs.withColumn("_h", F.xxhash64(key, F.lit(seed))), "_h", key, name="_at")
    return at.withColumn("batch", F.floor((F.col("_at") - 1) / size).cast("long")).drop("_h", "_at")
