"""URL filtering: fixed host and path rules first, then association rules mined by FP-growth.

``url_parts`` gives host and path. ``fixed_rule`` picks the longest of a short list of rules (a
parameter, so its size is bounded) that fits; of equally long ones that with the longer host, then the later
one. URLs that a fixed rule judges are the labelled rows: FP-growth mines their token combinations together
with an item for the label, rules that name the label block are pruned by support (a share of the rows, and a least
number of them), by confidence, and by confidence told from chance (its lower bound must be above the share of blocked
rows), as are those that a shorter one covers, and an inverted index (a rule's rarest token -> rule) matches them to every URL.

A URL's tokens are its scheme, top level, registered name, every other host label, every path segment, file
ending, what the last segment is made of, every query key, and whether it has a fragment; all of them, whole,
are mined and matched. Tokens that too few blocked rows have for any rule are left out. FP-growth lists all subsets of a
transaction, so it gets the tokens that are among the ``TERMS`` first of every row that has them: each such set is counted in
full. Sets with any other token are grown from conditional pattern bases (``grown``), one token a step, and only while they
could still become a rule that no shorter one covers; so long URLs lose no token and no rule.

Nulls: a null URL, or one without ``://``, has an empty host and path and no tokens; only a rule for
the empty host could judge it, else it is allowed. No labelled rows, or no rules left: all others are
allowed. A very long URL is one row, with as many tokens as it has parts. Empty table: empty result. Repeated
rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

TERMS = 12


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, each named by its kind."""
    tail = F.regexp_extract(path, r"([^/]*)/?\z", 1)
    labels = F.split(host, r"\.")
    single = {
        "scheme": F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1),
        "top": F.element_at(labels, -1),
        "name": F.substring_index(host, ".", -2),
        "ending": F.regexp_extract(tail, r"(\.[A-Za-z0-9]{1,5})\z", 1),
        "shape": F.when(tail.rlike(r"\A[0-9]+\z"), "digits").when(tail.rlike(r"\A[a-z-]+\z"), "letters").when(tail != "", "mixed"),
        "fragment": F.when(F.instr(url, "#") > 0, "yes"),
    }
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    several = {
        "sub": F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))),
        "dir": F.split(path, "/"),
        "key": F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1)),
    }

    def named(kind: str, v: Column) -> Column:
        return F.when(F.length(v) > 0, F.concat(F.lit(kind + "="), v))

    def each(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: named(kind, v))

    lists = [each(k, v) for k, v in several.items()]
    tokens = F.concat(F.array(*[named(k, v) for k, v in single.items()]), *lists)
    return F.when(host != "", F.array_distinct(F.array_compact(tokens))).otherwise(F.array().cast("array<string>"))


def token_counts(labelled: DataFrame) -> DataFrame:
    """(token, n): how many labelled rows have it."""
    return labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def lower_bound(share: Column, n: Column, deviations: float) -> Column:
    """Of a share seen in n rows, the lower end of its score interval."""
    z2 = deviations * deviations
    return (share + z2 / (2 * n) - deviations * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def grown(found: DataFrame, items: DataFrame, rows: int, need: int, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """(tokens, n, blocked) of the rules with an outer token, those that a shorter one with the same first token covers left out.

    found: (row, blocked, token) of labelled rows; items: (token, n, block, outer), how many rows have a token and how many
    of them are blocked. A set is written from its last token in a fixed order, in which outer ones come last, to its first.
    Its conditional pattern base are the tokens before its last written one, of all rows that have the set; equal ones are
    counted together. A set grows on unless it is a rule, has too few blocked rows, or has just the rows of a shorter set
    (then each rule with it has a shorter one that is as good). As each step takes rows away, growth ends.
    """
    key = F.struct("outer", (-F.col("n")).alias("order"), "token")
    growing = items.where(~holds(F.col("n"), F.col("block")) & (F.col("n") < rows))
    lists = found.join(growing.select("token", key.alias("key"), "outer"), "token").groupBy("row", "blocked")
    lists = lists.agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count_if("outer").alias("outer")).where("outer > 0")
    lists = lists.select("blocked", F.col("keys.token").alias("rest"), "outer").groupBy("rest", "outer").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
    first = lists.select("n", "blocked", "rest", "outer", F.posexplode("rest").alias("i", "token")).where(F.col("i") >= F.size("rest") - F.col("outer"))
    bases = written(first.select(F.array("token").alias("tokens"), F.slice("rest", F.lit(1), F.col("i")).alias("rest"), "n", "blocked"))
    sets = growing.where("outer").select(F.array("token").alias("tokens"), "n")
    rules = [items.where("outer").where(holds(F.col("n"), F.col("block"))).select(F.array("token").alias("tokens"), "n", F.col("block").alias("blocked"))]
    size = 1
    while True:
        longer = bases.select("tokens", "n", "blocked", "rest", F.posexplode("rest").alias("i", "token"))
        longer = longer.select(F.array_append("tokens", F.col("token")).alias("tokens"), F.slice("rest", F.lit(1), F.col("i")).alias("rest"), "n", "blocked")
        size += 1
        counted = longer.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).where(F.col("blocked") >= need)
        # every shorter set with the first token must have grown on, and have more rows
        without = F.transform(F.sequence(F.lit(2), F.lit(size)), lambda i: F.concat(F.slice("tokens", F.lit(1), i - 1), F.slice("tokens", i + 1, F.lit(size))))
        parts = counted.select("tokens", "n", F.explode(without).alias("part")).join(sets.select(F.col("tokens").alias("part"), F.col("n").alias("more")), "part")
        proper = parts.where(F.col("more") > F.col("n")).groupBy("tokens").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == size - 1)
        counted = written(counted.join(proper.select("tokens"), "tokens"))
        rules.append(counted.where(holds(F.col("n"), F.col("blocked"))))
        sets = counted.where(~holds(F.col("n"), F.col("blocked"))).select("tokens", "n")
        if sets.isEmpty():
            return reduce(DataFrame.unionByName, rules)
        bases = written(longer.join(sets.select("tokens"), "tokens").where(F.size("rest") > 0).groupBy("tokens", "rest").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, least: int = 1, deviations: float = 0.0, terms: int = TERMS) -> DataFrame:
    """Rules (tokens, confidence, support) that say block, from rows (tokens, verdict); none that a shorter rule covers.

    A rule holds in at least ``least`` rows, and its confidence, less so many deviations, is above the share of blocked rows.
    terms: how many tokens of a row FP-growth gets at most, which changes no rule.
    """
    rows = written(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "verdict"))
    n, blocked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("verdict") == "block")).first()
    share = blocked / max(n, 1)
    need = math.ceil(min(1.0, max(min_support, (least - 0.5) / n)) * n) if n else 1

    def holds(with_tokens: Column, blocked_ones: Column) -> Column:
        passes = (blocked_ones / with_tokens >= min_confidence) & (blocked_ones >= need)
        return passes & (lower_bound(blocked_ones / with_tokens, with_tokens, deviations) > share) if deviations else passes

    # fewer blocked rows than this can't be told from chance even if no other row has the tokens
    able = max(need, math.ceil(deviations**2 * share / (1 - share) - 1e-6)) if deviations and share < 1 else need
    tokens = rows.select("row", (F.col("verdict") == "block").cast("long").alias("blocked"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("block")).where(F.col("block") >= able)
    order = Window.partitionBy("row").orderBy(F.desc(F.col("block") / F.col("n")), F.desc("n"), "token")
    found = written(tokens.join(counts, "token").withColumn("rank", F.row_number().over(order)))
    items = written(found.groupBy("token", "n", "block").agg((F.max("rank") > terms).alias("outer")))
    outer = not items.where("outer").isEmpty()
    inner = found.join(items.where("outer").select("token"), "token", "left_anti") if outer else found
    inner = rows.select("row", "verdict").join(inner.groupBy("row").agg(F.collect_list("token").alias("tokens")), "row", "left")
    every = F.coalesce("tokens", F.array().cast("array<string>"))
    rows = inner.select(F.array_append(every, F.concat(F.lit("verdict="), "verdict")).alias("items"))
    support = min(1.0, (able - 0.5) / n) if n else 1.0
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.col("consequent")[0] == "verdict=block").select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    )
    if deviations:
        with_tokens = F.round(F.col("support") * n / F.col("confidence"))
        rules = rules.where(lower_bound(F.col("confidence"), with_tokens, deviations) > share)
    rules = rules.where(~F.exists("tokens", lambda t: t.startswith("verdict=")))
    if outer:
        more = grown(found, items, n, able, holds)
        rules = rules.unionByName(more.select(F.array_sort("tokens").alias("tokens"), (F.col("blocked") / F.col("n")).alias("confidence"), (F.col("blocked") / n).alias("support")))
    rules = written(rules)
    shorter = rules.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("fewer"))
    longer = rules.select("tokens", F.explode("tokens").alias("token")).join(shorter, "token")
    covered = longer.where((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.002, min_confidence: float = 0.9, least: int = 5, deviations: float = 2.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, confidence (of the mined rule that blocked it)."""
    url = F.col("url")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = url_parts(url)
    p = p.withColumns({"host": host, "path": path})
    p = p.withColumns({"fixed": fixed_rule(F.col("host"), F.col("path"), rules), "tokens": url_tokens(url, F.col("host"), F.col("path"))})
    p = written(p.select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", "fixed", "tokens"))
    labelled = p.where(F.col("fixed").isNotNull()).select("row", "tokens", F.col("fixed.verdict").alias("verdict"))
    mined = written(mine(labelled, min_support, min_confidence, least, deviations))
    # the inverted index: each rule under its rarest token, so that a URL meets a rule once at most, and few in vain
    index = mined.select("tokens", "confidence", F.explode("tokens").alias("token")).join(token_counts(labelled), "token")
    index = index.groupBy("tokens", "confidence").agg(F.min(F.struct("n", "token"))["token"].alias("token")).withColumnRenamed("tokens", "needs")
    open_rows = p.where(F.col("fixed").isNull())
    # equal token lists are judged once
    kinds = open_rows.select("tokens").distinct()
    hits = (
        kinds.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("confidence"))
    )
    hits = written(hits)
    return p.join(hits, (p["tokens"] == hits["tokens"]) & p["fixed"].isNull(), "left").select(
        "id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "confidence",
    )
