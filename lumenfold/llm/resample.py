"""Importance resampling towards a target distribution by hashed word n-grams.

A text is taken as UTF-8 bytes: one 256-byte table lower-cases A-Z and turns every ASCII character that isn't a
letter or digit into a space, ``bytes.split`` gives the words. A feature is a run of 1 to ``width`` words, joined by
one space; its bucket is its crc32 modulo ``buckets``, and the crc32 of a longer run goes on from that of the
shorter one (``zlib.crc32(b" " + word, seed)``), so no run is ever put together. Counters reduce the buckets of
each task's texts, then Spark sums these partial counts: the raw corpus S and the target T have ``buckets`` rows each,
whatever their size.

A bucket's gain is floor(1000 ln of its smoothed share in T over that in S), a document's weight the sum over its
features. Its score adds Gumbel noise from a hash of the seed and the id, so that the highest scores
are a draw without replacement in proportion to exp(weight / 1000). Scores are ranked by ranges: rows are sorted over
tasks, and a row's rank is its place in its range after all rows of the ranges before.

Nulls: a null text has no features, weight 0; a null id hashes as an empty one and goes last among ties. Ties
go to the smaller id, then fewer features, then the row read first. Repeated rows count each. A very long
text is split in blocks of ``BLOCK`` bytes, the words at a seam carried over. Empty tables (documents or target):
counts of 0; an empty result for no documents. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 1 << 20
#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, and blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def blocks_of(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about so many bytes at a time."""
    start = 0
    while start < len(text):
        piece = text[start : start + block].translate(TABLE)
        end = start + len(piece)
        while end < len(text) and piece[-1:] != b" ":  # go on to the end of the word
            more = text[end : end + 256].translate(TABLE)
            cut = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:cut], end + cut
        yield piece.split()
        start = end


def feature_counts(text: bytes, width: int, block: int = BLOCK) -> tuple[int, Counter]:
    """(number of words, how often each crc32 of a feature occurs)."""
    seen, n, before = Counter(), 0, []
    for new in blocks_of(text, block):
        n += len(new)
        words = before + new
        seeds = list(map(crc32, words))
        seen.update(seeds[len(before) :])
        spaced = [b" " + w for w in words] if width > 1 else []
        for k in range(1, width):  # runs of k + 1 words that end among the new ones
            seeds = list(map(crc32, spaced[k:], seeds))
            seen.update(seeds[max(0, len(before) - k) :])
        before = words[len(words) - width + 1 :] if 1 < width <= len(words) else words if width > 1 else []
    return n, seen


def bucket_counts(rows: DataFrame, text_col: str, width: int, buckets: int) -> DataFrame:
    """(bucket, n): the features of all texts, at most ``buckets`` rows; every task sends one Counter."""

    def count(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in some:
            for text in batch.column(0):
                for h, k in feature_counts(text.as_py(), width)[1].items():
                    total[h % buckets] += k
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    texts = rows.select(F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets)))) of every bucket."""
    s_all, t_all = float(sum(raw.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((raw.get(b, 0) + 1.0) * (t_all + buckets)))) for b in range(buckets)]


def gumbel(id_column: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with a rank from 1 in this order, by ranges of rows; its last columns must tell rows apart, so that no value fills a range alone."""
    place = F.monotonically_increasing_id()  # the number of the task, then that of the row in it
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    starts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per task
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.col("_start") + at + 1).drop("_place", "_part", "_start")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    width: int = 1, buckets: int = 10000, seed: int = 2024, least_words: int = 20, percent: int = 10,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null unless drawn).

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred are drawn.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    raw, wanted = (dict(map(tuple, bucket_counts(rows, col, width, buckets).collect())) for rows, col in ((docs, "text"), (target, target_text_col)))
    gain = gains(raw, wanted, buckets)  # one number a bucket

    def weigh(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            out = []
            for text in batch.column(1):
                n, seen = feature_counts(text.as_py(), width)
                out.append((n, sum(seen.values()), sum(gain[h % buckets] * k for h, k in seen.items())))
            columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_features", "weight"])

    rows = docs.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    best = ranked(rows.where(enough), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = best.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("id", "n_features", "weight", "score", "rank")
