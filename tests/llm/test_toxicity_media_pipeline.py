import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import entry, media, neardup, toxicity

FOLDER = "/root/testdata/sf0.001"
BAD = ["idiot", "moron", "stupid", "pathetic", "worthless"]


def labelled(spark, n=900):
    rng = random.Random(6)
    parts = ["the", "ing", "tion", "er", "on", "an", "st", "or"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 250))]
        if toxic:
            for _ in range(2 + len(w) // 40):
                b = rng.choice(BAD)
                if rng.random() < 0.4:  # a misspelling
                    k = rng.randrange(1, len(b))
                    b = b[:k] + b[k - 1] + b[k:]
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    out = docs.withColumn("z", toxicity.score(docs, model)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    right = [(r["z"] >= 0.5) == bool(r["toxic"]) for r in out]
    assert len(out) > 100 and sum(right) / len(right) > 0.95
    assert model.scores([""]) == model.scores(["   "]) and model.scores([""])[0] < 0.5
    clean = "the tionering anstor onering " * 20
    assert model.scores([clean])[0] < 0.5 < model.scores([clean + "stuupid idiiot worthlesss " + clean])[0]
    assert model.scores([clean + "STUPID! moron, (pathetic)"])[0] > 0.5


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, "y " * 50_000), (2, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r[0] for r in docs.select(toxicity.score(docs, model)).collect()] == pytest.approx([0.0] * 4)
    assert docs.limit(0).select(toxicity.score(docs, model)).count() == 0
    some = spark.createDataFrame([(1, 1), (2, None), (3, 0), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert all(0 <= r[0] <= 1 for r in docs.select(toxicity.score(docs, toxicity.fit(docs, some))).collect())


def test_toxicity_reads_words_to_their_end(spark):
    rng = random.Random(7)
    for n in [2, 38, 39, 40, 41, 42, 46, 47, 68, 73, 74, 75, 76, 108, 109, 500]:  # of a long word, every n-gram once
        word = "".join(rng.choice("ab.xy_") for _ in range(n - 2)).join("ab")
        short, toxicity.LONG = toxicity.LONG, 10**6
        try:
            want = np.sort(toxicity.ngrams([word])[1])
        finally:
            toxicity.LONG = short
        got = toxicity.words_of(word)
        assert all(len(w if isinstance(w, str) else w[0]) <= 40 for w in got)
        assert np.array_equal(np.sort(toxicity.ngrams(got)[1]), want)
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    clean = "_".join("the tionering anstor onering".split() * 20)
    bad = "_".join(["stuupid", "idiiot", "worthlesss", "moron", "pathetic", "stupid"])
    assert model.scores([clean])[0] < 0.5 < model.scores([f"{clean}_{bad}_{clean}"])[0]


def test_held_out_labels_are_no_input(spark):
    docs, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.v, b.v) and a.bias == b.bias


def test_one_id_with_many_texts_is_learnt_from_once(spark):
    docs, labels = labelled(spark, 200)
    many = docs.unionByName(spark.createDataFrame([(1, f"~{i} " * 9, "") for i in range(500)], docs.schema))  # after its own text
    a, b = toxicity.fit(docs, labels), toxicity.fit(many, labels)
    assert np.array_equal(a.v, b.v) and a.bias == b.bias


def test_accuracy_on_the_given_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = entry.op2_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right, found, toxic = scored.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert right / found > 0.95 and right / toxic > 0.85


def test_scores_of_the_query(spark):
    out = entry.op2_toxicity(spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert out.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 1024, 64 * 1024 + 1, 200_000])
def test_media_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    data = media.padded(raw)
    assert len(data) % 64 == 0 and len(data) >= 64 and data[:n] == raw and not any(data[n:])
    box = media.pack(data)
    (track,) = media.describe(box)
    assert media.payload(box, track) == data
    assert (track["codec"], track["ticks"]) == ("raw", len(data))
    for k, (offset, length) in enumerate(media.key_ranges(track)):
        assert box[offset : offset + length] == data[k * 64 * media.KEY_EVERY :][:64]


def test_media_of_another_writer():
    """A file with two chunks of unequal samples, 32-bit offsets and no sync table."""
    samples = [b"a" * 5, b"bb", b"c" * 9]
    full = lambda k, *p: media.full_box(k, *p)
    n = lambda *v: struct.pack(f">{len(v)}I", *v)
    mdat = media.box(b"mdat", samples[0] + samples[1] + b"gap" + samples[2])
    stbl = media.box(
        b"stbl", full(b"stsd", n(1), media.box(b"avc1", bytes(8))), full(b"stts", n(2, 2, 10, 1, 20)), full(b"stsc", n(2, 1, 2, 1, 2, 1, 1)),
        full(b"stsz", n(0, 3, 5, 2, 9)), full(b"stco", n(2, 8, 8 + 10)),
    )
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", full(b"mdhd", n(0, 0, 100, 40, 0)), media.box(b"minf", stbl))))
    (track,) = media.describe(mdat + moov + media.box(b"free", b"x"))
    assert media.payload(mdat + moov, track) == b"".join(samples)
    assert (track["codec"], track["ticks"], track["keys"].tolist()) == ("avc1", 40, [0, 1, 2])


def test_sample_feature():
    x = [3, 250, 250, 0, 7, 9] * 40
    mean = sum(x) // len(x)
    crossings = sum((a * len(x) >= sum(x)) != (b * len(x) >= sum(x)) for a, b in zip(x, x[1:]))
    assert media.sample_feature(bytes(x)) == f"mean={mean} power={sum(v * v for v in x) // len(x)} peak=250 crossings={crossings} mode=250"
    assert media.sample_feature(bytes(64)) == "mean=0 power=0 peak=0 crossings=0 mode=0"


@pytest.mark.parametrize("bad", [b"abc", struct.pack(">I4s", 4, b"moov"), struct.pack(">I4s", 99, b"mdat")])
def test_malformed_media(bad):
    with pytest.raises(ValueError):
        list(media.boxes(bad))


def test_media_columns(spark):
    rows = [(1, "aé\0"), (2, None), (None, ""), (3, "x" * 100_000), (4, "x" * 100_000), (1, "aé\0"), (9_007_199_254_740_993, "b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, feature string")
    got = media.media_columns(docs, keep_media=True).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((t or "").encode() for i, t in rows if i == r["id"])
        data = media.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert media.media_columns(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mix_sources", "byte_bpe"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    toxic = labels.where("toxic = 1").count()
    assert left.columns == docs.columns and docs.count() - 2 * toxic - 20 <= left.count() <= docs.count()
    one = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    want = {r["id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    taken = {r["id"]: r["copies"] for r in entry.mixing.mix_sources(docs, entry.mixing.word_count(F.col("text"))).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def test_pipeline_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, id long"
    rows = [(1, None, None, None, None, 0, 0), (None, "a b", "en", "s", 3, 0, 0), (None, "a b", "en", "s", 3, 0, 0), (2, "", "en", "s", 0, 0, 0), (2, "", "en", "s", 0, 0, 0), (3, "w " * 40_000, "en", "t", 1, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.encode(spark, docs, FOLDER).count() == len(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).count() == 5


def test_pipeline_with_any_other_columns(spark):
    """Columns named like anything the stages add, other data in each row: they come out as they went in."""
    names = ["row", "id", "hash", "least", "rows", "kept_id", "kept", "size", "of_id", "of_source", "of_size", "copies", "pick", "n", "copy", "_id", "_hash", "_size", "_n", "_copy", "score", "a.b"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    given = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r == given[r["doc_id"]] for r in found), name
    assert corpus_pipeline.encode(spark, docs, FOLDER).count() == len(given)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_oracles(spark):
    from tests.oracle import check, connection

    tables = connection(FOLDER)
    for name, sql in entry.oracle_sql().items():
        check(spark, tables, FOLDER, entry.queries()[name], sql)
