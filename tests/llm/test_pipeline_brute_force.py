"""The pipeline against plain Python, stage by stage, each on what the one before really kept."""

from collections import Counter

import numpy as np

import corpus_pipeline
from lumenfold.llm import toxicity

from .test_bpe import brute as tokens
from .test_chat_mixing_urls import brute_targets
from .test_neardup_topk_lm import brute_groups, words

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = dict(map(tuple, spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").collect()))
    given = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        kept[name] = docs.collect()

    # training on the same rows in the same order gives the same model, and its scores are those of plain sums
    fold = lambda i: spark.sql(f"SELECT crc32('{i}') % 5 AS f").first()["f"]
    rows = sorted((i, given[i]["text"] or "", y) for i, y in labels.items() if i in given and y is not None and fold(i) != 0)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    clean = {i for i, r in given.items() if plain_score(model, r["text"] or "") < 0.5}
    assert {r["doc_id"] for r in kept["toxicity"]} == clean

    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept["toxicity"]], 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted(set(groups.values()))

    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in kept["near_dedup"]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in kept["mix_sources"]:
        taken[r["source"]] += len(words(r["text"]))
        copies[r["doc_id"]] += 1
        assert r == given[r["doc_id"]]
    assert max(copies.values()) <= 3 and set(copies) <= set(groups.values())
    targets = brute_targets(sizes, (5, 2, 1), 3.0)
    for s, target in targets.items():
        own = sorted(len(words(r["text"])) for r in kept["near_dedup"] if r["source"] == s)
        assert abs(taken[s] - target) <= max(0.01 * target, own[len(own) // 2])

    want = sorted((r["doc_id"], *tokens(r["text"])) for r in kept["mix_sources"])
    assert sorted(map(tuple, corpus_pipeline.encode(spark, docs, FOLDER).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want  # the run as a whole, and again


def plain_score(model, text):
    """The definition: n-grams averaged into words, words into windows, the largest window."""
    z = []
    for w in toxicity.words_of(text):
        _, rows = toxicity.ngrams([w])
        z.append(sum(float(model.v[r]) for r in rows) / max(1, len(rows)))
    size = model.window
    starts = sorted({*range(0, max(0, len(z) - size), size // 2), max(0, len(z) - size)})
    best = max((sum(z[s : s + size]) / len(z[s : s + size]) for s in starts), default=0.0) if z else 0.0
    return 1 / (1 + np.exp(-np.clip(model.bias + best, -500, 500)))
