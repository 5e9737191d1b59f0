r"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word (white space split, lower case, outer punctuation removed; one of over ``LONG`` characters, as in
scripts without spaces, is a row of pieces, each a word of the window, that share out its n-grams) is the
average of the vectors of its character n-grams, which share hashed rows of one table, so an unseen
misspelling still has most of the vectors of the word it came from. The average over a window of ``WINDOW``
words goes through a linear softmax with two outputs. The table and the softmax start at random and are
trained jointly, in numpy: in the first epochs on random windows, then a document's label is put on its
window that looks most toxic so far (and, if it is clean, on a random one as well), since a few words make a
long document toxic. A document's score is the largest over its windows, which overlap by half and cover the
whole text. Only rows whose n-grams stand in some texts, and in more or fewer toxic ones than chance explains
(``SURE`` deviations), are trained; the others stay 0, so that single texts can't be learnt by heart.

``fit`` learns from at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean rows (documented bounds: the rows
smallest by a hash of the id), in one task; the model is one row. Scoring is linear in a word's vector, so
each word costs one number, kept in a bounded cache.

Nulls: a null text is empty; a text without words scores what the bias alone gives, under 0.5. Null ids
are kept; null labels aren't learnt from. No labelled rows, or of one class only: all scores are 0 or 1. Empty table: empty result.
Repeated rows score alike; an id with several labels is learnt from as toxic if one of them is, one with
several texts from the first of them by code points. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import crc_bucket, slices

BITS = 18
WINDOW, BUCKETS, DIM, EPOCHS, WARM, MIN_DOCS, RATE, CACHE = 50, 1 << BITS, 8, 10, 4, 4, 0.3, 200_000
MAX_TOXIC, MAX_CLEAN = 2000, 3000
SURE = 2.5
GRAMS = (2, 3, 4, 5, 6, 7)
LONG, SPAN = 40, 16  # characters from which a word is long, and of its pieces, which so weigh about as much as a word
STEP = SPAN - max(GRAMS) + 1  # where the next piece of a long word starts
Piece = tuple[str, bool]  # of a long word, and whether it is the last
EDGES = ".,;:!?\"'()[]{}<>|*%$&#@-_…«»“”‘’"


def pieces(word: str) -> list[str | Piece]:
    """The word itself, or pieces of a long one between its marks; each overlaps the next by what an n-gram can cross."""
    if len(word) <= LONG or len(bare := word.strip(EDGES)) <= LONG:
        return [word]
    marked = f"<{bare}>"
    starts = range(0, len(marked) - SPAN + STEP, STEP)
    return [(marked[lo : lo + SPAN], lo == starts[-1]) for lo in starts]


def words_of(text: str) -> list[str | Piece]:
    """The distinct words, in order of their first place: repetition says nothing about toxicity."""
    words = text.lower().split()
    if max(map(len, words), default=0) > LONG:
        words = [p for w in words for p in pieces(w)]
    return list(dict.fromkeys(words))


def ngrams(words: list[str | Piece]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, row of the table) of every n-gram of every word, between marks < and >; of a piece, those that start before the next one."""
    marked = [w[0] if isinstance(w, tuple) else f"<{w.strip(EDGES) or '-'}>" for w in words]  # so that every word has an n-gram
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    shared = np.repeat(np.fromiter((SPAN - STEP if isinstance(w, tuple) and not w[1] else 0 for w in words), np.int64, len(words)), sizes)
    owners, rows = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            fits = (left[:m] >= n) & (left[:m] > shared[:m])
            h = hashed[fits]
            owners.append(owner[:m][fits])
            rows.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32))
    if not owners:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    owners, rows = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owners, kind="stable")
    return owners[order], rows[order]


def window_sums(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of x over windows of size values, half overlapping, the last one ending with x; and where they start."""
    if len(x) <= size:
        return np.array([x.mean()]), np.array([0])
    starts = np.unique(np.r_[np.arange(0, len(x) - size, size // 2), len(x) - size])
    total = np.r_[0.0, np.cumsum(x)]
    return (total[starts + size] - total[starts]) / size, starts


class Model:
    """v: what a row of the table adds to the difference of the two outputs; bias: the rest of it."""

    def __init__(self, v: np.ndarray, bias: float, window: int) -> None:
        self.v, self.bias, self.window, self.cache = v, bias, window, {}

    def words(self, words: list[str | Piece]) -> np.ndarray:
        owner, rows = ngrams(words)
        return np.bincount(owner, self.v[rows], len(words)) / np.maximum(1, np.bincount(owner, minlength=len(words)))

    def scores(self, texts: list[str]) -> list[float]:
        """A batch at a time, so that words not seen before are worked out together."""
        docs, cache = [words_of(t) for t in texts], self.cache
        if len(cache) > CACHE:
            cache.clear()
        if new := list({w for d in docs for w in d if w not in cache}):
            cache.update(zip(new, self.words(new).tolist()))
        out = []
        for words in docs:
            z = self.bias
            if words:
                z += window_sums(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)), self.window)[0].max()
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def uneven_rows(docs: list[np.ndarray], y: np.ndarray, grams: list[np.ndarray], min_docs: int, sure: float) -> np.ndarray:
    """The rows of the table that are trained. Equal texts count once."""
    seen, n = np.zeros((2, BUCKETS)), [0, 0]
    for words, toxic in {(tuple(d.tolist()), t) for d, t in zip(docs, y.tolist())}:
        seen[toxic][np.unique(np.concatenate([grams[w] for w in words]))] += 1
        n[toxic] += 1
    share = seen.sum(0) / sum(n)
    off = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[1] + 1 / n[0]))
    return np.flatnonzero((seen.sum(0) >= min_docs) & (np.abs(off) >= sure))


def train(texts: list[str], labels: np.ndarray, window: int = WINDOW, dim: int = DIM, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, sure: float = SURE, rate: float = RATE, seed: int = 5) -> Model:
    """Joint training of the table E (rows x dim) and the softmax W (dim x 2), b, by gradient descent."""
    rng = np.random.default_rng(seed)
    number: dict[str | Piece, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    some = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in some], np.asarray(labels).astype(int)[some]
    if not some or not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), 500.0 if some and y.all() else -500.0, window)
    vocabulary, block = list(number), 20_000  # a block of words at a time
    parts = [ngrams(vocabulary[lo : lo + block]) for lo in range(0, len(vocabulary), block)]
    owner = np.concatenate([o + np.int32(lo) for (o, _), lo in zip(parts, range(0, len(vocabulary), block))])
    flat = np.concatenate([f for _, f in parts])
    del parts, vocabulary, number
    whole = np.bincount(owner)  # n-grams of each word
    used = uneven_rows(docs, y, np.split(flat, np.cumsum(whole)[:-1]), min_docs, sure)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = place[flat] >= 0
    owner, flat = owner[kept], place[flat[kept]]
    lengths = np.bincount(owner, minlength=len(whole))  # trained n-grams of each word
    starts = np.cumsum(lengths) - lengths
    E, W, b = rng.normal(0, 0.05, (len(used), dim)), rng.normal(0, 0.05, (dim, 2)), np.zeros(2)
    gE, gW, gb = np.full(len(used), 1e-8), np.full(2, 1e-8), np.full(2, 1e-8)
    weight = 0.5 * len(y) / np.where(y == 1, y.sum(), len(y) - y.sum())

    def random_window(i: int) -> tuple[int, np.ndarray]:
        at = rng.integers(max(1, len(docs[i]) - window + 1))
        return i, docs[i][at : at + window]

    for epoch in range(epochs):
        per_word = np.bincount(owner, (E @ (W[:, 1] - W[:, 0]))[flat], len(whole)) / whole
        picks = []
        for i, d in enumerate(docs):
            if epoch < WARM:
                picks += [random_window(i), random_window(i)]
                continue
            means, at = window_sums(per_word[d], window)
            picks.append((i, d[at[means.argmax()] :][:window]))
            if y[i] == 0 and len(d) > window:  # clean texts are clean anywhere
                picks.append(random_window(i))
        order = rng.permutation(len(picks))
        for lo in range(0, len(order), 64):
            batch = [picks[j] for j in order[lo : lo + 64]]
            who, words = np.array([i for i, _ in batch]), np.concatenate([w for _, w in batch])
            sizes = np.array([len(w) for _, w in batch])
            n = lengths[words]
            rows = flat[np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = np.repeat(np.repeat(np.arange(len(batch)), sizes), n)
            share = 1 / (np.repeat(whole[words], n) * sizes[at])
            h = np.stack([np.bincount(at, E[rows, k] * share, len(batch)) for k in range(dim)], 1)
            z = h @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(who)), y[who]] -= 1
            p *= weight[who][:, None]
            dW, db, dh = h.T @ p, p.sum(0), p @ W.T
            touched, inverse = np.unique(rows, return_inverse=True)
            dE = np.stack([np.bincount(inverse, dh[at, k] * share, len(touched)) for k in range(dim)], 1)
            gE[touched] += (dE * dE).mean(1)
            gW += (dW * dW).mean(0)
            gb += db * db
            E[touched] -= rate * dE / np.sqrt(gE[touched])[:, None]
            W -= 0.1 * dW / np.sqrt(gW)
            b -= 0.1 * db / np.sqrt(gb)
    v = np.zeros(BUCKETS)
    v[used] = E @ (W[:, 1] - W[:, 0])
    return Model(v, float(b[1] - b[0]), window)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learns from the labelled rows whose crc32(id) mod folds isn't held."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.where(crc_bucket(F.col("id"), folds) != held).groupBy("id").agg(F.max("toxic").alias("toxic"))
    take = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    sample = take[0].unionByName(take[1])  # bounded: at most max_toxic + max_clean rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one text for each id, so that the number of rows is bounded as well
    texts = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).repartition(1)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "text": [], "toxic": []}), *frames]).sort_values(["id", "text"])
        model = train(rows["text"].tolist(), rows["toxic"].to_numpy(int))
        yield pd.DataFrame({"v": [model.v.astype("<f4").tobytes()], "bias": [model.bias], "window": [model.window]})

    row = texts.mapInPandas(learn, "v binary, bias double, window int").first()
    if row is None:  # nothing to learn from
        return train([], np.empty(0))
    return Model(np.frombuffer(row["v"], "<f4"), row["bias"], row["window"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of text_col, for withColumn; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((model.v, model.bias, model.window))  # 4 bytes for each of BUCKETS rows

    @pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for texts in batches:
            yield pd.Series([x for part in slices(texts.tolist()) for x in own.scores(part)], dtype="float64")

    return toxic(F.coalesce(F.col(text_col), F.lit("")))
