"""Near-duplicate documents by b-bit MinHash with exact confirmation.

A document's set is that of its distinct word shingles, each a 64-bit hash (two different shingles meet
with a chance of 2^-64; nothing else is approximate in a confirmed link). Steps:

1. ``signatures``: per document the size and a hash of the set, a key for each band of minima, and the low
   ``BITS`` bits of all minima packed into longs.
2. Equal sets are one class; from here on one row, that of the smallest id, stands for each class.
3. Candidates: the classes of a band's bucket are paired with its hub, the class that shares most buckets
   with others (of a text and its edited copies, the text itself), never with one another. The similarity of
   a pair is estimated from the packed bits by bit counts, corrected for the 2^-BITS chance of equal low
   bits; pairs far below the threshold are dropped (6 standard deviations).
4. The rest is confirmed on full sets: one side's set travels to the other, the texts only of documents
   that are in some pair.
5. Confirmed links give components. Where a bucket still holds more than one component, its classes take part
   in a prefix-filter join, which is exact (``across``): with shingles ordered from the rarest to the most
   common, two sets that are to be linked share one among the first few of both, and how few follows from
   their sizes. A text that was edited too much for a link to its hub has its own edits there, which meet next
   to nothing, so hundreds of such copies are told apart without being paired. What meets passes the
   estimate, is confirmed as before, and joins the components.

So a component lacks a link only if its two documents share no band: with the default 32 bands of 5 minima
that has a chance of (1 - 0.85^5)^32 = 7e-9 at the threshold, and less above it.

Nulls: a null or blank text has an empty set and is linked with nothing. With fewer words than a shingle
has, the whole sequence is one shingle. A very long text is one row of 8 bytes a shingle where its set is
needed; its shingles are dealt over all tasks where sets meet. Null ids are left out of links and are their own component (null).
Rows that repeat an id stay rows; if their sets differ, the id links them all. Empty table: empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BANDS, ROWS, BITS = 32, 5, 4
PER_LONG = 64 // BITS


def shingle_hashes(text: str, width: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > 100_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 * (min(width, len(words)) + 1) % (1 << 64), np.uint64)
    for k in range(min(width, len(words))):  # the order of the words counts
        out = (out ^ h[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Per multiplier the smallest of the mixed hashes."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 2048):
        x = h[lo : lo + 2048, None] * a[None, :]
        x ^= x >> np.uint64(31)
        np.minimum(out, x.min(axis=0), out=out)
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each, PER_LONG to a long; rows are documents."""
    low = (m >> np.uint64(64 - BITS)).reshape(len(m), -1, PER_LONG)
    return (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    x = m.reshape(len(m), -1, rows)
    key = np.full(x.shape[:2], 0x2545F4914F6CDD1D, np.uint64)
    for k in range(rows):
        key = (key ^ x[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text) to (id, n, whole, bands, bits); whole: a hash of the set, null with bands and bits for the empty set."""
    a = _multipliers(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            n, whole, m = [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), width, cache)
                n.append(len(s))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                m.append(minima(s, a))
            m = np.stack(m) if m else np.empty((0, len(a)), np.uint64)
            lists = [pa.array([x if k else None for k, x in zip(n, y)], pa.list_(pa.int64())) for y in (band_keys(m, rows), packed(m))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), *lists], ["id", "n", "whole", "bands", "bits"])

    return docs.mapInArrow(sign, "id long, n long, whole binary, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column, longs: int) -> Column:
    """Similarity from two packed signatures: the share of equal low bits, corrected for chance."""
    ones = 0x1111111111111111
    differ = F.lit(0)
    for k in range(longs):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones))
        differ = differ + F.bit_count(x)
    equal = 1 - differ / float(longs * PER_LONG)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (id, root): each id of a link with the smallest id it reaches.

    Labels start as the ids. In a round each id takes the smallest label of its neighbours, passes it to
    the id that its old label names, and then jumps to its label's label; rounds end when no label moves,
    after about the logarithm of a component's diameter. All are joins and grouped minima, written each round.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", "root", F.least("root", "m").alias("m"))
        hook = step.where("m < root").groupBy(F.col("root").alias("at")).agg(F.min("m").alias("h"))
        hooked = written(step.join(hook, step["id"] == hook["at"], "left").select("id", F.col("root").alias("old"), F.least("m", "h").alias("root")))
        up = hooked.select(F.col("id").alias("up"), F.col("root").alias("top"))
        new = written(hooked.join(up, hooked["root"] == up["up"], "left").select("id", "old", F.least("root", "top").alias("root")))
        moved = new.where("root < old").limit(1).count()
        label = new.select("id", "root")
        if not moved:
            return label


def full_sets(some: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, set) of some classes, from the texts of the rows that stand for them."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        seen: set[int] = set()  # rows may repeat an id: a class needs its set once
        for pdf in frames:
            out = []
            for cls, whole, text in zip(pdf["cls"], pdf["whole"], pdf["text"]):
                if cls not in seen and xxhash.xxh3_128_digest((s := shingle_hashes(text, width, cache)).tobytes()) == whole:
                    seen.add(cls)
                    out.append((cls, s.view(np.int64)))
            yield pd.DataFrame(out, columns=["cls", "set"])

    some = classes.join(some.select("cls").distinct(), "cls").select("cls", "whole", F.col("rep").alias("id"))
    return written(docs.join(some, "id").select("cls", "whole", "text").mapInPandas(sets, "cls long, set array<long>"))


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with the sizes of their sets and of the intersection: a, b, same, na, nb."""
    # a's set travels to b's, once for each pair; a row of the result is numbers only
    sent = pairs.join(full.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
    both = sent.join(full.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb")).cast("long")
    return written(both.select("a", "b", same.alias("same"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb")))


def size_class(n: Column) -> Column:
    """Sizes within two percent of one another; it only has to grow with n."""
    return F.floor(F.log(n.cast("double")) / math.log(1.02) + 1e-9).cast("int")


def across(full: DataFrame, place: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a > b, of classes of different components that could be linked: all that are, and few others.

    full: (cls, set); place: (cls, root, loose), where one of a pair's classes must be loose. A set of n that
    shares at least num * (n + m) / (num + den) shingles with one of m shares one at a place i, from 0, with
    n - i at least that many. So a set sends its shingle i to the size classes of those m only, and a pair
    meets where both sides sent a shingle to the other's class.
    """
    grams = full.select("cls", F.explode("set").alias("shingle")).join(place.select("cls", "root"), "cls").select("cls", "root", "shingle")
    often = grams.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), (F.min("root") != F.max("root")).alias("open")).where("times > 1")
    ranked = grams.join(often, "shingle", "left")
    item = F.struct(F.coalesce("times", F.lit(1)).alias("times"), "shingle", F.coalesce("open", F.lit(False)).alias("open"))
    ranked = ranked.groupBy("cls").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("n", F.size("items").cast("long"))
    first = F.slice("items", 1, F.floor(F.col("n") * (den - num) / den).cast("int") + 1)
    sent = ranked.select("cls", "n", F.posexplode(first).alias("i", "item")).where("item.open")
    most = F.least(F.floor(F.col("n") * den / num), F.floor((F.col("n") - F.col("i")) * (num + den) / num) - F.col("n"))
    sent = sent.withColumns({"least": F.ceil(F.col("n") * num / den), "most": most}).where("least <= most")
    sent = sent.select("cls", "n", "i", "item.shingle", size_class(F.col("n")).alias("own"), F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("other"))
    sent = written(sent.join(place, "cls"))
    x, y = sent.where("loose").alias("x"), sent.alias("y")
    meets = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    shared = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = num * (F.col("x.n") + F.col("y.n")) <= (num + den) * shared
    once = ~F.col("y.loose") | (F.col("x.cls") < F.col("y.cls"))
    pairs = x.join(y, meets & (F.col("x.root") != F.col("y.root")) & enough & once)
    return pairs.select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, n, component (smallest id reachable), kept. Links: threshold[1] * intersection >= threshold[0] * union."""
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = written(signatures(docs, width, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    linked = signed.where("id IS NOT NULL AND n > 0")
    # a class per set: its smallest id stands for it, and that row's number names it
    classes = linked.groupBy("whole").agg(F.min(F.struct("id", "row")).alias("first"))
    classes = written(classes.select("whole", F.col("first.row").alias("cls"), F.col("first.id").alias("rep")))
    reps = linked.join(classes.select("cls"), linked["row"] == classes["cls"]).select("cls", "n", "bands", "bits")
    reps = written(reps)
    # an id with several sets ties their classes
    several = linked.groupBy("id").agg(F.collect_set("whole").alias("sets")).where(F.size("sets") > 1)
    several = several.select("id", F.explode("sets").alias("whole")).join(classes, "whole")
    ties = several.groupBy("id").agg(F.min("cls").alias("a"), F.collect_set("cls").alias("all")).select("a", F.explode("all").alias("b"))

    longs = -(-bands * rows // PER_LONG)
    t, k = num / den, bands * rows
    p = t + (1 - t) * 2.0**-BITS
    least = t - 6 * math.sqrt(p * (1 - p) / k) / (1 - 2.0**-BITS)

    sides = reps.select("cls", "n", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose smaller set can hold the intersection of a link and whose estimate isn't far below one."""
        both = pairs.join(sides.alias("x"), F.col("a") == F.col("x.cls")).join(sides.alias("y"), F.col("b") == F.col("y.cls"))
        sized = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
        return both.where(sized & (estimate(F.col("x.bits"), F.col("y.bits"), longs) >= least)).select("a", "b")

    buckets = written(reps.select("cls", F.posexplode("bands").alias("band", "key")))
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    shared = written(buckets.join(written(sizes.where("size > 1")), ["band", "key"]))
    # the hub is the class with the most company over all bands: of a text and its edited copies, the text itself
    company = written(shared.groupBy("cls").agg(F.sum("size").alias("company")))
    hubs = shared.join(company, "cls").groupBy("band", "key").agg(F.max_by("cls", F.struct(F.col("company"), -F.col("cls"))).alias("hub"))
    in_bucket = written(shared.select("band", "key", "cls").join(written(hubs), ["band", "key"]))
    stars = in_bucket.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    stars = written(likely(stars))
    paired = stars.select(F.col("a").alias("cls")).unionByName(stars.select(F.col("b").alias("cls")))
    by_hub = confirmed(stars, full_sets(paired, classes, docs, width))
    union = F.col("na") + F.col("nb") - F.col("same")
    is_link = F.col("same") * den >= union * num
    links = written(by_hub.where(is_link).select("a", "b").unionByName(ties))
    roots = components(links)

    # buckets that still hold several components: who isn't in a bucket's largest is loose
    placed = in_bucket.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("band", "key", "cls", F.coalesce("root", "cls").alias("root"))
    placed = written(placed)
    parts = placed.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("band", "key").agg(F.max(F.struct("size", "root")).alias("m"), F.count(F.lit(1)).alias("parts"))
    main = written(main.where("parts > 1").select("band", "key", F.col("m.root").alias("main")))
    place = written(placed.join(main, ["band", "key"]).groupBy("cls").agg(F.max("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("loose")))
    full = full_sets(place, classes, docs, width)
    cross = likely(across(full, place, num, den)).join(by_hub.select("a", "b"), ["a", "b"], "left_anti")
    more = confirmed(written(cross), full).where(is_link).select("a", "b")
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    # back to all rows: set -> class -> component, named by its smallest id
    named = classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("whole", "rep", F.coalesce("root", "cls").alias("root"))
    named = written(named)
    smallest = written(named.groupBy("root").agg(F.min("rep").alias("component")))
    named = written(named.join(smallest, "root").select("whole", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = signed.select("id", "n", "whole").join(named, "whole", "left").select("id", "n", component.alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("component") == F.col("id"), F.lit(True)))
