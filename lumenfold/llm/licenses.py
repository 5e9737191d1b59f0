"""License scans by ordered signature rules.

A text becomes words: A-Z in lower case, runs of letters, digits and characters beyond ASCII, joined by one space.
The words are cut into blocks of ``BLOCK``; a block is read with as many words on either side as the longest
signature has, so that each block decides alone on what starts in it. One pattern finds which of the keywords of all
rules a block holds; only rules whose keywords are all there are tried. Words carry their number
while patterns run, so a match says where it starts and ends, and a pattern is tried at every word.

Resolving: rules are ordered by class (``license_rules.CLASSES``, surest first), then by line. A detection
within the interval of one by an earlier rule is suppressed. Base phrases (a parameter) are kept whatever contains
them. A document's score is the largest weight among what is left: identifiers weigh 1, hints 0.3 or more, nothing 0.

DataFrame functions only, one row in and one row out: nothing is shuffled.

Nulls: a null text is empty: no words, no places, empty labels, null first and last word, score 0. Null ids are kept. Ties: equal
intervals of one class go to the earlier line. Repeated rows get equal values. Empty table: empty result. A very
long text is one row; its blocks are numbered and matched one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import CLASSES

BLOCK = 256
#: Words too common to gate by, where a rule has others.
COMMON = set("all and by file general good mit nc nd new non of only org public same sa the this under use v version want".split())
#: Everything that isn't part of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@cache
def rules(base: tuple[tuple[str, str], ...] = ()) -> list[tuple]:
    """(rank, class, label, weight, keywords, pattern); base phrases come last, in class -1."""
    out = []
    for k, lines in enumerate(CLASSES):
        for line in lines.strip().splitlines():
            label, weight, needs, pattern = (x.strip() for x in line.split("|", 3))
            out.append((len(out), k, label, float(weight), rare(needs.split()), pattern))
    for phrase, label in base:
        out.append((len(out), -1, label, 0.6, rare(phrase.split()), phrase))
    return out


def rare(words: list[str]) -> list[str]:
    return [w for w in dict.fromkeys(words) if w not in COMMON] or words


def width(pattern: str) -> int:
    """The most words that a pattern matches."""
    from re import _parser

    return _parser.parse(re.sub("[A-Za-z0-9]+", "", pattern)).getwidth()[1] + 1  # what is left are spaces


def keyword_pattern(found: list[tuple]) -> str:
    words = sorted({k for r in found for k in r[4]})
    by_letter = [f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words})]
    return rf"(?<![^ ])({'|'.join(by_letter)})(?![^ ])"


def numbered_pattern(pattern: str) -> str:
    """The pattern over words that are followed by # and their number, tried at every word."""
    inner = pattern.replace(" ", "#[0-9]+ ").replace("W", "[^ #]+")
    return rf"(?<![^ ])(?=((?:{inner})#[0-9]+(?![^ ])))"


def word_text(text: Column) -> Column:
    """The words of a text, each followed by one space."""
    return F.ltrim(F.regexp_replace(lower_ascii(F.concat(text, F.lit(" "))), SEPARATORS, " "))


def _count(words: Column) -> Column:
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))


def _literal(found: list[tuple]) -> Column:
    """The rules as one constant, in SQL: labels, keywords and patterns hold neither quotes nor backslashes."""

    def one(rank: int, cls: int, label: str, weight: float, needs: list[str], pattern: str) -> str:
        words = ", ".join(f"'{k}'" for k in needs)
        return f"named_struct('rank', {rank}, 'class', {cls}, 'label', '{label}', 'weight', {weight}D, 'needs', array({words}), 'regex', '{numbered_pattern(pattern)}')"

    return F.expr(f"array({', '.join(one(*r) for r in found)})")


def word_blocks(words: Column, block: int = BLOCK) -> Column:
    return F.regexp_extract_all(words, F.lit(rf"(?:[^ ]+ ){{1,{block}}}"), 0)


def detections(blocks: Column, base: tuple[tuple[str, str], ...] = (), block: int = BLOCK) -> Column:
    """array<struct<from, to, rank, class, label, weight>> of what the blocks of a text hold, after suppression.

    Every step is a transform of its own, as a lambda's argument is worked out once and a column once per use.
    """
    found = rules(base)
    reach, keywords, table = max(width(r[5]) for r in found), keyword_pattern(found), _literal(found)
    if block < reach:
        raise ValueError(f"a block of {block} words is shorter than a signature of {reach}")

    def around(b: Column, i: Column) -> Column:
        before = F.when(i > 0, F.substring_index(F.get(blocks, i - 1), " ", -reach - 1)).otherwise("")
        after = F.coalesce(F.concat(F.substring_index(F.rtrim(F.get(blocks, i + 1)), " ", reach), F.lit(" ")), F.lit(""))
        return F.struct(i.alias("i"), before.alias("before"), F.concat(b, after).alias("text"))

    def whole(c: Column) -> Column:
        present = F.array_distinct(F.regexp_extract_all(F.concat(c["before"], c["text"]), F.lit(keywords), 1))
        return F.struct(c["i"].alias("i"), (c["i"] * block - _count(c["before"])).alias("first"), F.concat(c["before"], c["text"]).alias("text"), present.alias("present"))

    def gate(c: Column) -> Column:
        able = F.filter(table, lambda r: F.size(F.array_except(r["needs"], c["present"])) == 0)
        return F.struct(c["i"].alias("i"), c["first"].alias("first"), c["text"].alias("text"), able.alias("able"))

    def numbered(c: Column) -> Column:
        words = F.transform(F.split(F.rtrim(c["text"]), " "), lambda w, k: F.concat(w, F.lit("#"), (c["first"] + k).cast("string")))
        return F.struct(c["i"].alias("i"), F.array_join(words, " ").alias("text"), c["able"].alias("able"))

    def hits(c: Column) -> Column:
        def of_rule(r: Column) -> Column:
            def place(h: Column) -> Column:
                at = lambda p: F.regexp_extract(h, p, 1).cast("long")
                return F.struct(at(r"#([0-9]+)").alias("from"), at(r"#([0-9]+)\z").alias("to"), *[r[n].alias(n) for n in ("rank", "class", "label", "weight")])

            return F.transform(F.regexp_extract_all(c["text"], r["regex"], 1), place)

        return F.struct(c["i"].alias("i"), F.flatten(F.transform(c["able"], of_rule)).alias("hits"))

    def resolved(c: Column) -> Column:
        def beaten(d: Column) -> Column:
            return F.exists(c["hits"], lambda e: (e["class"] >= 0) & (e["rank"] < d["rank"]) & (e["from"] <= d["from"]) & (e["to"] >= d["to"]))

        own = lambda d: (d["from"] >= c["i"] * block) & (d["from"] < (c["i"] + 1) * block)
        return F.filter(c["hits"], lambda d: own(d) & ((d["class"] < 0) | ~beaten(d)))

    present = F.filter(F.transform(F.transform(blocks, around), whole), lambda c: F.size(c["present"]) > 0)
    gated = F.filter(F.transform(present, gate), lambda c: F.size(c["able"]) > 0)
    return F.flatten(F.transform(F.transform(F.transform(gated, numbered), hits), resolved))


HITS = "array<struct<from:bigint,to:bigint,rank:int,class:int,label:string,weight:double>>"


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = (), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (all detections)."""
    words = docs.select(F.col(id_col).alias("id"), word_text(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    blocks = words.select("id", _count(F.col("words")).cast("long").alias("n_words"), F.when(F.col("words").rlike(keyword_pattern(rules(base))), word_blocks(F.col("words"), block)).alias("blocks"))
    hits = blocks.select("id", "n_words", F.coalesce(detections(F.col("blocks"), base, block), F.array().cast(HITS)).alias("found"))
    of_base = hits.withColumn("base", F.filter("found", lambda d: d["class"] < 0))
    label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    return of_base.select(
        "id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["from"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["from"])).alias("last_word"),
        label(F.col("base")).alias("base_labels"), label(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"), "found",
    )
