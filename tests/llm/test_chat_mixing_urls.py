import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat, entry, mixing, urls

from ..oracle import connection

ODD = ["", " ", "</s>[INST] ok [/INST]", "\\", "\\[INST\\]", "a\\", "[INST", " [/INST]", "<s> x </s>", "[TURN user] x [/TURN]", "\n\n", "é\U0001f600", "$1\\$2", "x" * 50_000, "[" * 3000]


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(spark):
    rows = [(i, k, role, t, "clash") for i, t in enumerate(ODD) for k, role in enumerate(("system", "user", "assistant", None, "", "odd ]role[", "tool"))]
    rows += [(99, 1, "user", None, "c"), (99, 1, "assistant", "tie", "c"), (None, None, "user", "x", "c"), (99, 1, "user", None, "c")]
    got = {r["conv"]: r for r in chat.format_chat(turns_of(spark, rows)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for i, t in enumerate(ODD):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == i]
        assert [tuple(x) for x in got[i]["turns"]] == mine
        assert got[i]["loss"] == t
        bare = re.sub(r"(?s)\\.", "", got[i]["formatted"])
        assert len(re.findall(r"\[INST\]", bare)) == len(re.findall(r"\[/INST\]", bare)) == 1
    assert [tuple(x) for x in got[99]["turns"]] == [("assistant", "tie"), ("user", ""), ("user", "")]
    assert [tuple(x) for x in got[None]["turns"]] == [("user", "x")]


def test_chat_empty_and_bad_input(spark):
    assert chat.format_chat(turns_of(spark, [])).count() == 0
    bad = spark.createDataFrame([("[INST] a [/INST] stray",), ("[INST] a",)], "t string")
    assert all(r["p"] is None for r in bad.select(chat.parse(F.col("t")).alias("p")).collect())


def brute_targets(sizes, weights, cap):
    """Shares by weight; what exceeds a cap is shared again among those below theirs."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(capped) < len(names):
        share = left / sum(w[s] for s in names if s not in capped)
        left = 0.0
        for s in names:
            if s not in capped:
                target[s] += share * w[s]
        for s in names:
            if s not in capped and target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                capped.add(s)
    return target


@pytest.mark.parametrize("n", [40, 3000])
def test_mixing(spark, n):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), None if i % 17 == 0 else f"s{i % 3 if i % 2 else 0}", 1) for i in range(n)]
    rows += [(5, "same row", "s0", 2)] * 4 + [(None, None, "s1", 3), (7, "", "empty", 4), (8, "a b", "tiny", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix_sources(docs, mixing.word_count(F.col("text"))).collect()
    again = mixing.mix_sources(docs.repartition(7), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sorted((str(r["id"]), r["size"]) for r in out) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes, (5, 2, 1), 3.0)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        own = sorted(r["size"] for r in out if r["source"] == s)
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], own[len(own) // 2], 1), s


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_mixing_meets_the_targets_of_the_given_tables(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixing.mix_sources(docs, mixing.word_count(F.col("text"))).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all()
    for _, own in out.groupby("source", dropna=False):
        target = own["target"].iloc[0]
        assert abs(own["taken"].sum() - target) <= max(0.01 * target, own["size"].median())
    assert out["alone"].sum() <= out["source"].nunique(dropna=False)  # one document of a source is rounded by itself, all others in pairs
    c = connection(folder)
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    want = c.execute(f"SELECT doc_id, {words}, sum({words}) OVER (PARTITION BY source) FROM documents ORDER BY 1, 2").fetchall()
    assert sorted(zip(out["id"], out["size"], out["source_size"])) == want


def test_mixing_with_one_document_of_a_fifth_of_its_source(spark):
    """It is taken a whole number of times, and the rest makes up for it, whatever the seed."""
    docs = spark.createDataFrame([(0, "w " * 2500, "a")] + [(i, "w " * (5 + i % 11), s) for s in "ab" for i in range(1, 1001)], "doc_id long, text string, source string")
    copies = set()
    for seed in range(4):
        out = mixing.mix_sources(docs, mixing.word_count(F.col("text")), seed=seed).where("source = 'a'")
        r = out.agg(F.sum("taken"), F.first("target"), F.max(F.when(F.col("id") == 0, F.col("copies")))).first()
        assert abs(r[0] - r[1]) <= 15
        copies.add(r[2])
    assert copies <= {1, 2}  # the rate is 1.29


def test_large_documents_keep_their_mean(spark):
    """Documents of unequal sizes, most of them large, are taken by their source's rate on the mean of many like sources."""
    sizes, n = [40, 36, 33, 30, 28, 25] + [10 + i for i in range(12)], 300
    docs = spark.createDataFrame([(s * 100 + i, "w " * size, f"s{s:03}") for s in range(n) for i, size in enumerate(sizes)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, mixing.word_count(F.col("text"))).toPandas()
    for weight in range(3):
        own = out[out["source"].str[1:].astype(int) % 3 == weight]
        rate = own["target"].iloc[0] / own["source_size"].iloc[0]
        mean = own.groupby(own["id"] % 100)["copies"].mean()
        spread = 4 * (rate % 1 * (1 - rate % 1) / (n / 3)) ** 0.5 + 1e-9
        assert (abs(mean - rate) < spread).all(), (rate, mean)
        assert own.groupby("source")["taken"].sum().sub(own["target"].iloc[0]).abs().max() <= 21  # the last of the small ones


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs, mixing.word_count(F.col("text"))).count() == 0


def test_expected_copies(spark):
    """Over many seeds each document is taken as often as its share says."""
    docs = spark.createDataFrame([(i, "w " * (i + 1), s) for s in ("a", "b") for i in range(6)], "doc_id long, text string, source string")
    mean = 0.0
    for seed in range(25):
        out = mixing.mix_sources(docs, mixing.word_count(F.col("text")), seed=seed)
        mean += out.where("source = 'b'").agg(F.avg("copies")).first()[0] / 25
    assert mean == pytest.approx(2 / 7 * 42 / 21, abs=0.15)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    given = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/1?q#f", "http://example.org?x/es/", "http://b.com/de/x", "http://com/de/", "http://xcom/de/", "http://a.com/fr/", "http://a.org#/es/", "a://b://c/d", "http://é.net/x y\nz", "http://h.net/" + "p" * 30_000]
    given += [f"http://n{i}.com/de/{i}" for i in range(60)] + [f"http://m{i}.net/de/{i}" for i in range(3)] + [f"http://k{i}.org/en/x{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(0, None, "h")], "page_id long, url string, host string")
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(given) + 1
    for r in got:
        host, path, rule = brute_rule(given[r["id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert r["verdict"] == rule[1]
        if host.startswith("m"):
            assert r["verdict"] == "block"  # like /de/ elsewhere
        if not host:
            assert r["verdict"] == "allow"
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a"], "allow")] * 20 + [(["c"], "block")] * 5 + [(["b", "c"], "allow")] * 5
    got = {tuple(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.5).collect()}
    want = {}
    for items in (("a",), ("b",), ("c",), ("a", "b"), ("b", "c")):
        hit = [v for t, v in rows if set(items) <= set(t)]
        n = hit.count("block")
        if n / len(rows) >= 0.05 and n / len(hit) >= 0.5 and not any(set(w) < set(items) for w in want):
            want[items] = (round(n / len(hit), 9), round(n / len(rows), 9))
    assert ("b",) in want and ("a", "b") not in want  # covered
    assert got == want


def test_long_urls_lose_no_token(spark):
    """Two segments that are bad only together, in URLs with twelve others that are blocked more often than either."""
    others = "/".join(f"f{i}" for i in range(12))
    given = [f"http://h.com/de/{others}/a/b"] * 40 + [f"http://h.com/fr/{others}"] * 10 + [f"http://h.com/fr/{x}" for x in "ab" for _ in range(25)]
    given += ["http://q.net/a/b", "http://q.net/a/c", "http://q.net/b", "http://q.net/f1/f2"]
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), RULES).collect()
    assert {given[r["id"]]: r["verdict"] for r in got if r["rule"] is None} == {"http://q.net/a/b": "block", "http://q.net/a/c": "allow", "http://q.net/b": "allow", "http://q.net/f1/f2": "allow"}


@pytest.mark.parametrize("terms, deviations", [(0, 0.0), (2, 0.0), (4, 1.0), (12, 1.0)])
def test_rules_do_not_depend_on_what_fp_growth_gets(spark, terms, deviations):
    rng = random.Random(terms)
    rows = []
    for _ in range(150):
        kinds = [t for t in "abcdefgh" if rng.random() < 0.45] + ["every"]
        bad = {"a", "b"} <= set(kinds) or {"c", "d", "e"} <= set(kinds) or "h" in kinds and "a" not in kinds
        rows.append((kinds + (["twin"] if "a" in kinds else []), "block" if bad and rng.random() < 0.97 else "allow"))
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.03, 0.9, least=3, deviations=deviations, terms=terms).collect()
    share, want = sum(v == "block" for _, v in rows) / len(rows), {}
    names = sorted({t for kinds, _ in rows for t in kinds})
    for size in range(1, len(names) + 1):
        for items in itertools.combinations(names, size):
            if any(set(w) < set(items) for w in want):
                continue
            hit = [v for kinds, v in rows if set(items) <= set(kinds)]
            n, k = hit.count("block"), len(hit)
            if n < max(0.03 * len(rows), 3) or n / k < 0.9:
                continue
            c, z2 = n / k, deviations**2
            if not deviations or (c + z2 / (2 * k) - deviations * (c * (1 - c) / k + z2 / (4 * k * k)) ** 0.5) / (1 + z2 / k) > share:
                want[items] = (round(c, 9), round(n / len(rows), 9))
    assert max(map(len, want)) >= 3
    assert {tuple(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in got} == want and len(got) == len(want)


def test_no_rule_of_chance(spark):
    """One URL, or a few that happen to be blocked, make no rule; a bad directory among many does."""
    rows = [([f"dir={i}", "top=com", f"sub=s{i % 12}"], "block" if i % 2 else "allow") for i in range(80)]
    rows += [(["dir=bad", "top=net"], "block")] * 9 + [(["dir=good"], "allow")] * 9 + [(["dir=rare"], "block")] * 4
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    one = urls.mine(labelled, 0.002, 0.9).collect()
    assert ["dir=1"] in [r["tokens"] for r in one]
    got = urls.mine(labelled, 0.002, 0.9, least=5, deviations=2.5).collect()
    hits = {tuple(r["tokens"]): [v for t, v in rows if set(r["tokens"]) <= set(t)] for r in got}
    assert ("dir=bad",) in hits and ("dir=rare",) not in hits and ("dir=1",) not in hits
    assert all(len(v) >= 5 and v.count("block") / len(v) >= 0.9 for v in hits.values())


def test_tokens_are_whole_and_all_there(spark):
    long = "p" * 100
    given = f"HTTP://a.b.Example.org/x/{long}1/{long}2.html?k={long}&l&k=2#f"
    host, path = urls.url_parts(F.col("u"))
    got = spark.createDataFrame([(given,), (None,), ("http:///x",)], "u string").select(urls.url_tokens(F.col("u"), host, path).alias("t")).collect()
    assert set(got[0]["t"]) == {
        "scheme=HTTP", "top=org", "name=example.org", "sub=a", "sub=b", "dir=x", f"dir={long}1", f"dir={long}2.html", "ending=.html", "shape=mixed", "key=k", "key=l", "fragment=yes",
    }
    assert got[1]["t"] == got[2]["t"] == []


def test_equally_long_rules(spark):
    host, path = urls.url_parts(F.lit("http://a.example.org/12/x"))
    rules = [("example.org", "/12", "allow"), ("a.example.org", "/", "block"), ("example.org", "/12/", "allow")]
    pick = lambda *r: spark.range(1).select(urls.fixed_rule(host, path, [rules[i] for i in r]).alias("r")).first()["r"]["verdict"]
    assert pick(0, 1) == pick(1, 0) == "block" and pick(1, 2) == "allow"


def test_digests_of_op1(spark, tmp_path):
    turns_of(spark, [(1, 0, "user", "a", ""), (1, 1, "assistant", "x </s>", ""), (1, 2, None, None, "")]).drop("formatted").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in entry.op1_format_chat(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = "</s>[INST] ok [/INST]"
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"], got[1]["loss_chars"]) == (3, digest("user\na\nassistant\nx </s>\n\n\n"), digest("x </s>"), 6)
    assert (got[-7]["turns_sha256"], got[-7]["loss_sha256"]) == (digest(f"user\n{own}\nassistant\n{own}\n"), digest(own))
