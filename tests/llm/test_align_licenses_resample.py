import hashlib
import itertools
import json
import math
import random
import re
from collections import Counter
from zlib import crc32

import public_tokenizers as tokenizers
import pytest

from lumenfold.llm import align, entry, license_rules, licenses, resample

from ..oracle import check, connection

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a ", "a  b", "a b", "a\nb c", "\n", "▁ x", "x ▁", "a▁b c", "<|endoftext|> hi <s> </s> <unk> <0x41>", "日本語 の テキスト", "é à ﬁ \U0001f600", "a b c d", "x" * 3000, "it's we'll 123 4567!!! ---", "\x00 \x1c a \x85 b"]


def whole(texts):
    """The contract, text by text, without parts: every pair of tokens whose bytes overlap is looked for by its spans."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    entries = {i: e for e, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    letters = align.byte_letters()
    rows = []
    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(letters[c] for c in entries[i]) for i in a]
        b_bytes = [align.piece_bytes(b_model.id_to_piece(i)) for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append((0, 0, 0, [], ""))
            continue
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        spans = [[(e - len(t), e, i) for e, t, i in zip(ends, parts, ids)] for ends, parts, ids in ((a_ends, a_bytes, a), (b_ends, b_bytes, b))]
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            links += [(i, z) for x, y, z in itertools.takewhile(lambda t: t[0] < e, spans[1][k:]) if x < e and s < y]
        groups, last = [], 0
        for e in sorted(set(a_ends) & set(b_ends)):
            groups.append("|".join(",".join(str(i) for s, t, i in side if last <= s and t <= e) for side in spans))
            last = e
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    docs = Counter(p for r in rows for p in set(r[3]))
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(r[0], r[1], r[2], len(r[3]), sum(docs[p] == most[p[0]] for p in r[3]), sum(docs[p] for p in r[3]), r[4]) for r in rows]


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "cat's", "été", "日本語", "12345", "!!--", "\U0001f600", "hyper-text", "<s>", "antidisestablishment", "a\nb", "\t", "Zzyzx", "▁" * (seed == 2)]
    return ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("block, section, remembered", [(1 << 20, 1 << 18, 1 << 18), (30, 40, 20), (1, 1, 1)])
def test_alignment_equals_spans_of_whole_texts(spark, monkeypatch, block, section, remembered):
    texts = ODD + mixed_texts(60) + mixed_texts(5, 2) + ["same text again"] * 4
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    monkeypatch.setattr(align.sections, "__defaults__", (section,))
    both = align.Aligner(A, B)
    for n_a, _, _, n_links, digest, pairs, times in both.texts(texts):
        assert len(set(pairs)) == len(pairs) and times.sum() == n_links and (n_a > 0) == (digest != "")
    rows = [(i if i != 3 else None, t, "c", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, block int").repartition(3)
    got = align.align_texts(docs, A, B, block=block).collect()
    want = [(r[0], *w) for r, w in zip(rows, whole(texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("section, slice_, remembered", [(1, 1 << 20, 1 << 18), (30, 1, 50), (1 << 18, 100, 1)])
def test_alignment_in_sections(monkeypatch, section, slice_, remembered):
    texts = mixed_texts(40) + ODD
    as_rows = lambda found: [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist()))) for r in found]
    want = as_rows(align.Aligner(A, B).texts(texts))
    monkeypatch.setattr(align.sections, "__defaults__", (section,))
    monkeypatch.setattr(align, "SLICE", slice_)
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    assert as_rows(align.Aligner(A, B).texts(texts)) == want
    assert ["".join(x for x, _ in s) for s in align.slices_of(["", None])] == [""]
    for t in mixed_texts(40):
        assert " ".join(align.sections(t)) == t and align.cut_parts(t) == align.CUT.split(t)


def test_alignment_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:-1] + (r["groups_sha256"],) for r in entry.op11_align_tokens(spark, "/root/testdata/sf0.001").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, whole([r["text"] for r in rows]))}


def test_alignment_of_nothing(spark):
    assert align.align_texts(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [tuple(r) for r in align.align_texts(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def expanded(pattern):
    """All texts a rule's pattern matches, W as it is."""
    if g := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
        return set().union(*(expanded(pattern[: g.start()] + x + pattern[g.end() :]) for x in [*g[1].split("|"), *[""] * bool(g[2])]))
    return {pattern}


def test_rules_are_sound():
    found = licenses.rules(entry.BASE_PHRASES)
    assert len(found) > 250 and len(license_rules.CLASSES) == 5
    for _, _, label, weight, needs, pattern in found:
        for match in expanded(pattern):
            assert match == " ".join(match.split()) and set(needs) <= set(match.split()), pattern
        assert 0 < weight <= 1 and licenses.width(pattern) == max(len(m.split()) for m in expanded(pattern))


def brute_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = []
    for rank, cls, label, weight, _, pattern in licenses.rules(entry.BASE_PHRASES):
        for i in range(len(words)):
            if m := re.match(f"(?:{pattern.replace('W', '[^ ]+')})(?![^ ])", " ".join(words[i : i + 40])):
                hits.append((i, i + m[0].count(" "), rank, cls, label, weight))
    kept = [d for d in hits if d[3] < 0 or not any(e[3] >= 0 and e[2] < d[2] and e[0] <= d[0] and e[1] >= d[1] for e in hits)]
    base = [d[0] for d in kept if d[3] < 0]
    names = lambda ds: ",".join(sorted({d[4] for d in ds}))
    return len(words), len(base), min(base, default=None), max(base, default=None), names([d for d in kept if d[3] < 0]), names(kept), max([d[5] for d in kept], default=0.0)


def license_texts():
    rng = random.Random(3)
    signatures = sorted(m.replace("W", "acme") for r in licenses.rules() for m in list(expanded(r[5]))[:2])
    some = lambda n: " ".join(rng.choice(["foo", "the", "license", "by", "gnu", "Ünder", "1"]) for _ in range(n))
    texts = [f"{some(rng.randrange(12))} {rng.choice(signatures).upper()}, ({rng.choice(signatures)})\n{some(rng.randrange(12))}" for _ in range(60)]
    texts += [" -- ".join(signatures), "cc by cc-by cc.by CC BY-NC 4.0", "mit licenses amit license mit  license", "x " * 9000 + "Apache License", "gnu general public license " * 300]
    return [None, "", " ", "...", "é", *texts]


@pytest.mark.parametrize("block", [licenses.BLOCK, 24])
def test_scan_equals_brute_force(spark, block):
    texts = license_texts() if block > 24 else license_texts()[:40]
    rows = [(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(0, None, "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, found int")
    got = licenses.scan(docs, entry.BASE_PHRASES, block=block).drop("found").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute_scan(t)) for i, t, *_ in rows), key=str)
    assert licenses.scan(docs.limit(0), entry.BASE_PHRASES).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, entry.BASE_PHRASES, block=7)


def test_scan_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), entry.BASE_PHRASES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op12_scan_licenses", "op13_importance_resampling"])
def test_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    check(spark, connection(folder), folder, entry.queries()[name], entry.oracle_sql()[name])


def plain_features(text, width):
    words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return len(words), Counter(crc32(b" ".join(words[i : i + k])) for k in range(1, width + 1) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_features_in_blocks(width, block):
    for text in ["", " ", "a", "Ab C d", "é x, Y-z 12.5", "x" * 900 + " " + "y" * 300, *mixed_texts(20)]:
        assert resample.feature_counts(text.encode(), width, block) == plain_features(text, width)


@pytest.mark.parametrize("width, least, percent", [(1, 20, 10), (2, 3, 50), (1, 1, 100)])
def test_resampling_equals_brute_force(spark, width, least, percent):
    texts = [None, "", "...", *mixed_texts(120, 5)]
    rows = [(i % 100 if i != 5 else None, t, "clash", 3) for i, t in enumerate(texts)] + [(7, "one two three " * 9, "clash", 3)] * 3
    target = ["the cat's 12345", None, "Zzyzx the the"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int").repartition(4)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=97, least_words=least, percent=percent).collect()
    counts = [plain_features(t, width) for _, t, *_ in rows]
    s, t = Counter(), Counter()
    for total, found in ((s, [c for _, c in counts]), (t, [plain_features(x, width)[1] for x in target])):
        for c in found:
            for h, k in c.items():
                total[h % 97] += k
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)]
    scored = []
    for (i, *_), (n, c) in zip(rows, counts):
        weight = sum(gain[h % 97] * k for h, k in c.items())
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        scored.append((i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log(u))), n))
    enough = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    want = [(*x[:4], k + 1 if k < len(enough) * percent // 100 else None) for k, x in enumerate(enough)] + [(*x[:4], None) for x in scored if x[4] < least]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_resampling_of_nothing(spark):
    docs, target = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "a b")], [(1, "a")]))
    assert resample.resample(docs.limit(0), target).collect() == []
    assert [r["rank"] for r in resample.resample(docs, target.limit(0), least_words=1, percent=100).collect()] == [1]
