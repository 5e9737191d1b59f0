import base64
import functools
import hashlib
import math
import random

import public_tokenizers as tokenizers
import pytest
import regex

from lumenfold.llm import bpe

RANKS = tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def merged(word):
    """Byte-level BPE of one pre-token by its definition: the pair of lowest rank is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        pairs = [ranks().get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
        if (least := min(pairs)) == math.inf:
            break
        at = pairs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks()[p] for p in parts]


def brute(text):
    ids = [i for m in regex.finditer(tokenizers.PATTERN, text or "") for i in merged(m[0].encode())]
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


PARTS = ["the", " cat's", "  ", "\n\n\n", "\t", "été", "日本語のテキスト", "12345", "!!!---", "\U0001f600", "x" * 150, " " * 90, "'re", "<|endoftext|>", "\x00", "'", "''s's"]


def mixed(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(n))


@pytest.mark.parametrize("chunk, overlap, spread", [(40, 12, 1 << 18), (40, 12, 100), (64, 32, 1000), (bpe.CHUNK, bpe.OVERLAP, 0), (bpe.CHUNK, bpe.OVERLAP, bpe.SPREAD)])
def test_equals_whole_text_encoding(spark, chunk, overlap, spread):
    rng = random.Random(chunk)
    texts = [None, "", " ", "a", "x" * 1000, " " * 1000, "\n" * 300 + "z"] + [mixed(rng, n) for n in (1, 5, 30, 90, 200, 400)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, "a", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = bpe.encode_texts(docs, RANKS, tokenizers.PATTERN, chunk=chunk, overlap=overlap, spread=spread).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(t)) for i, t, _ in rows], key=str)


@pytest.mark.parametrize("chunk, overlap", [(20, 10), (30, 4), (200, 30)])
def test_pieces_start_where_pre_tokens_do(chunk, overlap):
    splitter, several = regex.compile(tokenizers.PATTERN), 0
    for seed in range(150):
        text = mixed(random.Random(seed), 60)
        pieces = bpe.pieces_of(splitter, text, chunk, overlap)
        starts = {m.start() for m in splitter.finditer(text)}
        at = 0
        for p in pieces:
            assert at in starts
            at += len(p)
        assert "".join(pieces) == text
        several += len(pieces) > 1
    assert several > 120  # in the others one long word fills the overlaps


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(docs, RANKS, tokenizers.PATTERN).count() == 0
