r"""Language-model scores by a probabilistic suffix tree, beside a unigram base.

Tokens are lower-case words and one end. A text's symbols are the bytes of its words with one space
between, then a line feed for the end; words hold neither, so symbols and tokens name each other. The tree's
contexts are the last 0 to ``DEPTH`` bytes, across words (line feeds stand before the first). Counts of all
(context, next byte) of the training texts are summed by Spark. A context is kept if it was seen twice and its
next-byte distribution diverges from that of the context one byte shorter: its count times the divergence must reach
``NATS`` times the root of the corpus's bytes. The divergences of a depth add up to at most log(256) nats a byte, so the
number of contexts grows with the root of the corpus. A kept context's distribution is smoothed with that of
its longest kept suffix (Witten-Bell), down to add-one over the 256 bytes. Each byte is scored at its longest kept
suffix. The tree is held as sorted arrays of what was seen, and each distinct run of bytes in a list of texts is looked
up once.

A tree of any size is used whole. One of more than ``SENT`` counts is cut into pieces of about so many (``pieces_of``):
ranges of contexts read backwards, so that all suffixes of a context lie in its own range or hold its whole start. Each
piece is sent out by itself and scores the bytes after its contexts, and a text's score is the sum over the pieces.

The unigram base needs the exact count of every token: those with a share of at least 2^-``FREQUENT_BITS`` of
the corpus (so at most 2^FREQUENT_BITS words) are sent out, all others are met by a join.

Nulls: a null text is empty: one token, the end. A null id isn't held out. Empty table: empty result; an
empty training part: uniform bytes, and counts of 0. Repeated rows stay rows. A very long text
is one row, whose runs of bytes are handled as one list. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

DEPTH, NATS, SENT, FREQUENT_BITS, SLICE, CACHED = 5, 0.005, 1 << 22, 18, 1 << 20, 1 << 20
END, SPACE = 10, 32


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbols(docs: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of some documents, depth line feeds before each, and how many each has to score."""
    parts, start = [], bytes([END]) * depth
    sizes = np.empty(len(docs), np.int64)
    for i, words in enumerate(docs):
        body = b" ".join(words)
        parts += (start, body, b"\n")
        sizes[i] = len(body) + 1
    return np.frombuffer(b"".join(parts), np.uint8), sizes


def grams_of(docs: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of depth + 1 bytes that ends in each symbol to score, packed into a long, and the place of its document."""
    s, sizes = symbols(docs, depth)
    g = np.zeros(max(0, len(s) - depth), np.uint64)
    for k in range(depth + 1):
        g = (g << np.uint64(8)) | s[k : len(s) - depth + k]
    starts = np.cumsum(sizes + depth) - sizes - depth
    keep = np.ones(len(g), bool)
    for k in range(depth):  # runs that end in the line feeds before a text
        keep[starts[1:] - depth + k] = False
    return g[keep], np.repeat(np.arange(len(docs)), sizes)


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their counts."""
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values, at = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in counts]), len(values)).astype(np.int64)


def corpus_counts(train: DataFrame, depth: int) -> DataFrame:
    """(gram, word, n) of the training texts, one of gram and word null; the empty word is the end. One pass, one shuffle."""

    def rows(gram: np.ndarray, gram_n: np.ndarray, words: Counter) -> Iterator[pa.RecordBatch]:
        names, size = ["gram", "word", "n"], 1 << 17  # rows of a batch: what the JVM holds at once
        for lo in range(0, len(gram), size):
            g = pa.array(gram[lo : lo + size].view(np.int64))
            yield pa.RecordBatch.from_arrays([g, pa.nulls(len(g), pa.binary()), pa.array(gram_n[lo : lo + size])], names)
        every = list(words.items())
        for lo in range(0, len(every), size):
            w, n = zip(*every[lo : lo + size])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch.column("text").to_pylist(), SLICE):
                docs = [words_of(t) for t in part]
                for d in docs:
                    words.update(d)
                words[b""] += len(docs)
                found.append(np.unique(grams_of(docs, depth)[0], return_counts=True))
                if len(words) > 300_000 or sum(len(g) for g, _ in found) > 2_000_000:
                    found = [summed(found)]
                    if len(words) > 300_000 or len(found[0][0]) > 1_400_000:  # bounded memory: partial counts go on
                        yield from rows(*found[0], words)
                        words, found = Counter(), []
        if words:
            yield from rows(*summed(found), words)

    counted = train.mapInArrow(count, "gram long, word binary, n long")
    return written(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")))


def kept_contexts(grams: DataFrame, depth: int, least: float) -> DataFrame:
    """(k, ctx, next, n, gain) of the root and of the contexts whose gain in nats is at least least.

    Keys are contexts, and no context has more than 256 next bytes or 256 longer ones: no group is large.
    """
    levels = [None] * (depth + 1)
    level = grams.select(F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("next"), "n")
    for k in range(depth, -1, -1):
        if k < depth:
            level = level.select(F.col("ctx").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx"), "next", "n").groupBy("ctx", "next").agg(F.sum("n").alias("n"))
        level = written(level)
        levels[k] = level
    out = levels[0].select(F.lit(0).alias("k"), "ctx", "next", "n", F.lit(float("inf")).alias("gain"))
    for k in range(1, depth + 1):
        often = levels[k].groupBy("ctx").agg(F.sum("n").alias("all")).where("all >= 2")
        shorter = levels[k - 1].withColumnRenamed("n", "m")
        whole = levels[k - 1].groupBy("ctx").agg(F.sum("n").alias("m_all"))
        own = levels[k].join(often, "ctx")
        up = own.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        up = up.join(shorter.select(F.col("ctx").alias("up"), "next", "m"), ["up", "next"]).join(whole.select(F.col("ctx").alias("up"), "m_all"), "up")
        gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("all")) / (F.col("m") / F.col("m_all"))))
        passed = up.groupBy("ctx").agg(gain.alias("gain")).where(F.col("gain") >= least)
        out = out.unionByName(own.join(passed, "ctx").select(F.lit(k).alias("k"), "ctx", "next", "n", "gain"))
    return written(out)


def backwards(k: Column, ctx: Column, depth: int) -> tuple[Column, Column]:
    """The range, end excluded, of the contexts of depth bytes that end in ctx (k bytes), as numbers whose first byte is the last of the context."""
    lo = F.lit(0).cast("long")
    for i in range(depth):
        lo = lo + F.shiftleft(F.shiftright(ctx, 8 * i).bitwiseAND(F.lit(255)), 8 * (depth - 1 - i))
    return lo, lo + F.element_at(F.array(*[F.lit(1 << 8 * (depth - i)) for i in range(depth + 1)]).cast("array<long>"), k + 1)


def pieces_of(kept: DataFrame, depth: int, sent: int) -> list[tuple[int, int]]:
    """Ranges of backward contexts that hold about sent counts of the tree each, none left out. Few counts share a start, so no range is large."""
    n = -(-kept.count() // sent)
    inner = []
    if n > 1:
        lo, _ = backwards(F.col("k"), F.col("ctx"), depth)
        inner = kept.select(F.percentile_approx(lo, [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted({0, *inner, 1 << 8 * depth})
    return list(zip(bounds, bounds[1:]))


class Tree:
    """The kept contexts as arrays. levels[k - 1]: contexts of k bytes (sorted), their counts and numbers of next bytes; then (context, next) and counts."""

    def __init__(self, root: np.ndarray, levels: list[tuple[np.ndarray, ...]], depth: int) -> None:
        self.root, self.levels, self.depth = root, levels, depth
        self.piece: tuple[int, int] | None = None  # the range of backward contexts it is made for; None: all
        self.known, self.value = np.empty(0, np.uint64), np.empty(0)  # runs that were looked up before

    @classmethod
    def build(cls, k: np.ndarray, ctx: np.ndarray, nxt: np.ndarray, n: np.ndarray, depth: int) -> Tree:
        """From the rows of kept_contexts as arrays."""
        root = np.ones(256)
        np.add.at(root, nxt[k == 0], n[k == 0])
        levels = []
        for at in range(1, depth + 1):
            own = k == at
            gram = (ctx[own].astype(np.uint64) << np.uint64(8)) | nxt[own].astype(np.uint64)
            order = np.argsort(gram)
            gram, count = gram[order], n[own][order].astype(np.float32)
            names, first, kinds = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
            sums = np.add.reduceat(count.astype(np.float64), first) if len(first) else np.empty(0)
            levels.append((names, sums, kinds.astype(np.float32), gram, count))
        return cls(root / root.sum(), levels, depth)

    @classmethod
    def collect(cls, kept: DataFrame, depth: int, piece: tuple[int, int]) -> Tree:
        """Of the counts whose contexts meet a piece, about SENT of them: its own, and those of the few suffixes of its first context."""
        lo, hi = backwards(F.col("k"), F.col("ctx"), depth)
        rows = kept.where((lo < piece[1]) & (hi > piece[0])).select("k", "ctx", "next", "n").toArrow()
        tree = cls.build(*(rows.column(c).to_numpy() for c in ("k", "ctx", "next", "n")), depth)
        tree.piece = None if piece == (0, 1 << 8 * depth) else piece
        return tree

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each run of depth + 1 bytes after the others. Runs are distinct and sorted."""
        runs, back = [grams], []  # of depth + 1, depth, ... bytes: few distinct ones are left, each looked up once and in order
        for k in range(self.depth - 1, -1, -1):
            shorter, at = np.unique(runs[-1] & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            runs.append(shorter)
            back.append(at)
        p = self.root[runs.pop().astype(np.intp)]
        for names, sums, kinds, own, count in self.levels:
            gram, p = runs.pop(), p[back.pop()]
            if not len(names):
                continue
            ctx = gram >> np.uint64(8)
            at = np.minimum(np.searchsorted(names, ctx), len(names) - 1)
            kept = np.flatnonzero(names[at] == ctx)
            at, gram = at[kept], gram[kept]
            place = np.minimum(np.searchsorted(own, gram), len(own) - 1)
            seen = np.where(own[place] == gram, count[place], 0.0)
            p[kept] = (seen + kinds[at] * p[kept]) / (sums[at] + kinds[at])
        return np.log10(p)

    def score(self, docs: list[list[bytes]]) -> np.ndarray:
        """Log10 probability of each document's symbols; of a piece, of those after its contexts."""
        grams, owner = grams_of(docs, self.depth)
        if self.piece:
            back = (grams >> np.uint64(8)).byteswap() >> np.uint64(64 - 8 * self.depth)
            own = (back >= self.piece[0]) & (back < self.piece[1])
            grams, owner = grams[own], owner[own]
        distinct, at = np.unique(grams, return_inverse=True)
        return np.bincount(owner, self.looked_up(distinct)[at], len(docs))

    def looked_up(self, runs: np.ndarray) -> np.ndarray:
        """log10 of distinct, sorted runs, by way of a bounded cache."""
        if not len(self.known):
            self.known, self.value = runs, self.log10(runs)
            return self.value
        at = np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)
        hit = self.known[at] == runs
        out = np.empty(len(runs))
        out[hit] = self.value[at[hit]]
        out[~hit] = self.log10(runs[~hit])
        every, values = np.concatenate([self.known, runs[~hit]]), np.concatenate([self.value, out[~hit]])
        if len(every) > CACHED:
            every, values = runs, out
        order = np.argsort(every, kind="stable")
        self.known, self.value = every[order], values[order]
        return out


def score_piece(docs: DataFrame, tree: Tree) -> DataFrame:
    """(row, part): of each text's score, what a piece of the tree adds."""
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text").to_pylist(), SLICE):
                values = sent.value.score([words_of(t) for t in part])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), pa.array(values, pa.float64())], ["row", "part"])
                at += len(part)

    scored = written(docs.select("row", "text").mapInArrow(score, "row long, part double"))
    sent.unpersist()
    return scored


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, nats: float = NATS, most: int | None = None, sent: int = SENT) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. held: a condition on the column id.

    most: a caller may ask for a smaller model, by a stricter test; by default the tree is whole. sent: counts of a piece, which changes no score.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    counts = corpus_counts(docs.where(~F.col("held_out")).select("text"), depth)
    vocab = counts.where("word IS NOT NULL").select("word", "n")
    grams = counts.where("gram IS NOT NULL").select("gram", "n")
    tokens, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    strict = nats * float(total) ** 0.5
    kept = kept_contexts(grams, depth, strict)
    while most is not None and kept.where(F.col("gain") >= strict).count() > most:
        strict *= 2
    kept = kept.where(F.col("gain") >= strict)
    pieces = pieces_of(kept, depth, sent)
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    if len(pieces) > 1:
        docs = written(docs)  # all passes see the same numbers
    least = max(1.0, tokens / (1 << FREQUENT_BITS))
    below = float(np.log10(tokens + kinds + 1.0))
    often = vocab.where(F.col("n") >= least).select("word", (F.log10(F.col("n") + 1.0) - below).alias("x")).toArrow()  # at most 2^FREQUENT_BITS words
    often = dict(zip(often.column("word").to_pylist(), often.column("x").to_pylist()))
    first = spark.sparkContext.broadcast((Tree.collect(kept, depth, pieces[0]), often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = first.value
        for batch in batches:
            at = 0
            for part in slices(batch.column("text").to_pylist(), SLICE):
                texts = [words_of(t) for t in part]
                values = own.score(texts)
                base, known_n, rare, rare_n, ends = [], [], [], [], [0]
                for words in texts:
                    sums, n_known = known.get(b"", -below), int(b"" in known)
                    for w, n in Counter(words).items():
                        if (c := known.get(w)) is None:
                            rare.append(w)
                            rare_n.append(n)
                        else:
                            sums += n * c
                            n_known += n
                    base.append(sums)
                    known_n.append(n_known)
                    ends.append(len(rare))
                lists = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(rare_n, pa.int64())], ["word", "n"])
                columns = [batch.column(c).slice(at, len(part)) for c in ("row", "id", "held_out")]
                columns += [pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(values, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists)], ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                at += len(part)

    schema = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"
    scored = written(docs.mapInArrow(score, schema))
    first.unpersist()
    met = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    met = met.join(vocab.where(F.col("n") < least), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = met.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(c + 1.0) - below)).alias("rest"), F.coalesce(F.sum(F.when(c > 0, F.col("times"))), F.lit(0)).alias("rest_known")
    )
    out = scored.drop("rare").join(rest, "row", "left")
    if len(pieces) > 1:
        others = [score_piece(docs, Tree.collect(kept, depth, p)).withColumn("piece", F.lit(i)) for i, p in enumerate(pieces[1:])]
        parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda p: p["part"])  # in order, so that reruns agree
        more = reduce(DataFrame.unionByName, others).groupBy("row").agg(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("more"))
        out = out.join(more, "row").withColumn("score", F.col("score") + F.col("more"))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
