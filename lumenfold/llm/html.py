"""Main text of web pages by minimum-cut labelling.

A page is scanned once into blocks of text (what stands between block tags), each with its open tags, their
class, id and role words, its length and the share of it inside links. A classifier turns these into two
costs, of calling the block content and of calling it boilerplate: the capacities of its edges to the sink
and from the source. Smoothness edges tie neighbours in page order and blocks that share a container (DOM
proximity). The minimum cut by maximum flow separates content from boilerplate; what can never be content
(script, style, head, templates, form controls) isn't a block at all.

The classifier adds log odds from three sides. ``features`` is what a block and its place look like without
any name: lengths, links, sentences, position, its neighbours, the share of the page that its container
holds; their weights are a logistic regression. Words of class, id and role have learnt log odds. Both are
learnt from the pages that mark their article element, which is hidden from them: ``fit`` counts names
over all of these (hashed to ``NAMES_HELD`` numbers, so that no name is left out), and fits the weights and
the strengths of the smoothness edges on at most ``FITTED`` of them, the first by a hash of the page. So a
page that marks nothing is judged by its looks, by the names that other pages use, and by what stands around a
block. What elements and some words are meant for (``TAG_PRIOR``, ``WORD_PRIOR``) is the third side.

White space inside a block becomes one space; character references are decoded once; blocks are joined by a
line feed. A br is white space inside its block. Nulls: null html is empty, as is a page without content
blocks; null ids and urls are kept. Malformed markup: unclosed tags end with their parent, head at the first thing
that can't stand in it, form controls at the next block tag, stray end tags
are ignored, a reference without a semicolon is decoded as browsers do. Empty table: empty result. Repeated
rows are treated alike. A very long page is one row; scan, features and flow are about linear in its blocks. Other
columns are ignored.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what the HTML standard says of them.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW = set("script style textarea title xmp noembed noframes iframe".split())
NEVER = set("script style head template noscript select button textarea iframe object svg math canvas audio video dialog title xmp noembed noframes option input label".split())
#: What may stand in a head; anything else ends it. Form controls, which end at the next block tag if they have no end tag.
HEAD = set("base basefont bgsound link meta title style script noscript noframes template".split())
CONTROLS = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in ("select", "button", "label", "option")}
#: A start tag that closes an open one.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Evidence for content (positive) and boilerplate (negative), in nats: of an element, and of a word in class, id or role.
TAG_PRIOR = {"article": 4.0, "main": 2.5, "nav": -7.0, "header": -5.0, "footer": -7.0, "aside": -7.0, "menu": -7.0, "search": -7.0, "form": -14.0, "h1": 1.0, "p": 1.0, "blockquote": 0.5, "pre": 0.5}
WORD_PRIOR = {
    "article": 2.0, "content": 1.5, "post": 1.0, "entry": 1.5, "story": 1.5, "body": 0.5, "main": 1.5, "text": 0.5,
    "ad": -6.0, "ads": -6.0, "advert": -6.0, "advertisement": -6.0, "banner": -5.0, "sponsor": -6.0, "sponsored": -6.0, "promo": -6.0, "promotion": -6.0,
    "nav": -6.0, "navigation": -6.0, "menu": -6.0, "breadcrumb": -6.0, "breadcrumbs": -6.0, "navbar": -6.0, "toc": -4.0, "pagination": -6.0, "pager": -6.0,
    "header": -4.0, "masthead": -6.0, "footer": -7.0, "foot": -4.0, "copyright": -6.0, "legal": -5.0,
    "sidebar": -7.0, "aside": -6.0, "widget": -6.0, "related": -6.0, "recommended": -6.0, "popular": -6.0, "trending": -6.0, "complementary": -7.0,
    "comment": -7.0, "comments": -7.0, "commentlist": -7.0, "disqus": -7.0, "reply": -6.0, "replies": -6.0, "respond": -6.0, "discussion": -6.0, "reviews": -4.0,
    "cookie": -7.0, "cookies": -7.0, "consent": -7.0, "gdpr": -7.0, "notice": -6.0, "alert": -5.0, "popup": -6.0, "modal": -6.0, "overlay": -5.0, "newsletter": -6.0, "subscribe": -6.0, "signup": -6.0, "login": -6.0,
    "share": -5.0, "sharing": -5.0, "social": -6.0, "follow": -5.0, "search": -6.0, "form": -5.0, "contentinfo": -7.0, "skip": -5.0, "hidden": -4.0, "tags": -4.0,
}
WORD_SPLIT = re.compile(r"[^a-z]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAMES_HELD, FITTED = 1 << 16, 600
PRIOR_SHARE = 0.6  # of the lists above, so that they don't drown what is learnt
#: Kinds of smoothness edges: neighbours in one container, with equal or other tags; other neighbours; in one container, with others between.
LIKE, BESIDE, NEXT, APART = range(4)
LAMBDAS = (0.8, 0.6, 0.3, 0.5)  # where there is nothing to learn from


@dataclass
class Block:
    tags: tuple[tuple[int, str], ...]  # (element number, name) of the open elements, from the outside
    words: frozenset[str]  # of class, id and role of these
    text: list[str] = field(default_factory=list)
    linked: int = 0


def names_of(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for m in NAMES.finditer(attributes) if attributes and "=" in attributes or "hidden" in attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            found.add("hidden")
        else:
            found.update(w for w in WORD_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1)
    return frozenset(found)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, without what is never content."""
    out: list[Block] = []
    stack: list[tuple[int, str, frozenset[str]]] = []
    never = links = serial = at = 0
    unended: set[int] = set()  # form controls without an end tag
    block: Block | None = None

    def add(raw: str) -> None:
        nonlocal block
        if stack and stack[-1][1] == "head" and raw.strip():
            close(len(stack) - 1)
        if never:
            return
        text = references.unescape(raw) if "&" in raw else raw
        if block is None:
            if not text.strip():
                return
            block = Block(tuple((i, t) for i, t, _ in stack), frozenset().union(*(w for *_, w in stack)) if stack else frozenset())
            out.append(block)
        block.text.append(text)
        if links:
            block.linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal never, links, block
        for i, t, _ in stack[depth:]:
            unended.discard(i)
            never -= t in NEVER
            links -= t == "a"
            if t in BLOCK:
                block = None
        del stack[depth:]

    while at < len(page):
        lo = page.find("<", at)
        if lo < 0:
            add(page[at:])
            break
        m = TOKEN.match(page, lo)
        if not m:  # a bare <
            add(page[at : lo + 1])
            at = lo + 1
            continue
        if lo > at:
            add(page[at:lo])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[lo + 1] == "/":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] == tag:
                    close(depth)
                    break
                if stack[depth][1] in ("article", "body", "table", "td", "main") and tag not in ("html", "body", "article", "main", "table"):
                    break  # a stray end tag doesn't close what is around
            if tag in BLOCK:
                block = None
            continue
        if stack and stack[-1][1] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "body":
            for depth, (_, t, _) in enumerate(stack):
                if t == "head":
                    close(depth)
                    break
        if tag in BLOCK and unended:
            for depth, (i, *_) in enumerate(stack):
                if i in unended:
                    close(depth)
                    break
        if tag == "br":
            add(" ") if block is not None else None
            continue
        if tag in BLOCK:
            block = None
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] in CLOSES.get(tag, ()) or stack[depth][1] == "p" and tag != "p":
                    close(depth)
                    break
                if stack[depth][1] in BLOCK:
                    break
        if tag in VOID or m[2].rstrip().endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        stack.append((serial, tag, names_of(m[2]) if tag != "form" else frozenset()))  # a form is judged by its tag and what it holds
        never += tag in NEVER
        links += tag == "a"
        if tag in CONTROLS and not ((end := CONTROLS[tag].search(page, at)) and end[1]):
            unended.add(serial)
        if tag in RAW:  # no markup inside
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag not in NEVER:
                add(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    return out


def clean(block: Block) -> str:
    return " ".join("".join(block.text).split())


def wrappers(blocks: list[Block]) -> set[int]:
    """The forms around a page: those that hold an article or main element or most of the text."""
    sizes = [len("".join(b.text).strip()) for b in blocks]
    held: dict[int, int] = {}
    found: set[int] = set()
    for b, n in zip(blocks, sizes):
        forms: list[int] = []
        for i, t in b.tags:
            if t == "form":
                forms.append(i)
                held[i] = held.get(i, 0) + n
            elif t in ("article", "main"):
                found.update(forms)
    return found | {i for i, n in held.items() if 2 * n > sum(sizes)}


def place(block: Block) -> tuple[str, int]:
    """The tag of the block's own element, and the number of the container around that."""
    around = [(i, t) for i, t in block.tags if t in BLOCK]
    own = around[-1][1] if around else ""
    return own, around[-2][0] if len(around) > 1 else 0


def features(blocks: list[Block], texts: list[str], bare: bool = False) -> np.ndarray:
    """What blocks look like, without names and without elements that mark content or boilerplate: a row each. bare: as if of div elements alone."""
    n = len(blocks)
    own, container = zip(*map(place, blocks))
    size = np.array([len(t) for t in texts], float)
    linked = np.minimum(1.0, np.array([b.linked for b in blocks]) / np.maximum(1, size))
    ends = np.array([t.count(".") + t.count("!") + t.count("?") + t.count("\u3002") for t in texts]) / size
    words = np.array([t.count(" ") + 1 for t in texts], float)
    _, which = np.unique(np.array(container), return_inverse=True)
    held, members = np.bincount(which, size)[which], np.bincount(which)[which]
    log = np.log1p(size)
    before, after = np.r_[0.0, log[:-1]], np.r_[log[1:], 0.0]
    links_around = np.r_[1.0, linked[:-1]] + np.r_[linked[1:], 1.0]
    at = (np.arange(n) + 0.5) / n
    is_in = lambda *tags: np.array([t in tags and not bare for t in own], float)
    return np.column_stack([
        np.ones(n), log, linked, 100 * ends, size / words, before, after, links_around, at, at * at,
        held / size.sum(), np.log1p(members), np.log1p(held), linked * (words < 8),
        is_in("p", "blockquote", "pre"), is_in("h1", "h2", "h3", "h4", "h5", "h6"), is_in("li", "dt", "dd"), is_in("td", "th"),
    ])


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: two blocks and a kind."""
    out = []
    own, container = zip(*map(place, blocks))
    last: dict[int, int] = {}  # element -> its last block so far
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEXT if container[i] != container[i - 1] else LIKE if own[i] == own[i - 1] else BESIDE))
        for element, tag in reversed(b.tags):  # the block before in the nearest common container
            if element in last and tag not in ("html", "body"):
                if last[element] < i - 1:
                    out.append((last[element], i, APART))
                break
        for element, _ in b.tags:
            last[element] = i
    return out


def held_name(word: str) -> int:
    return zlib.crc32(word.encode()) % NAMES_HELD


@dataclass
class Model:
    """names: log odds by held_name; weights: of features; lambdas: of the kinds of edges."""

    names: np.ndarray | None = None
    weights: np.ndarray | None = None
    lambdas: tuple[float, ...] = LAMBDAS

    def looks(self, blocks: list[Block], texts: list[str]) -> np.ndarray:
        if self.weights is not None:
            return np.clip(features(blocks, texts) @ self.weights, -4, 4)
        size = np.array([len(t) for t in texts], float)
        share = np.array([b.linked for b in blocks]) / np.maximum(1, size)
        return np.minimum(1.5, size / 120) - 0.5 - np.where(share > 0.5, 4.0 * share, 0.0)

    def log_odds(self, blocks: list[Block], texts: list[str]) -> np.ndarray:
        """Nats for content over boilerplate."""
        around = wrappers(blocks)
        given = np.empty(len(blocks))
        for k, b in enumerate(blocks):
            tags = {t for i, t in b.tags if i not in around}
            meant = sum(TAG_PRIOR.get(t, 0.0) for t in tags if not (t == "header" and "article" in tags))
            meant += sum(WORD_PRIOR.get(w, 0.0) for w in b.words)
            given[k] = PRIOR_SHARE * meant
            if self.names is not None and b.words:
                given[k] += float(np.clip(sum(self.names[held_name(w)] for w in b.words), -4, 4))
        return np.clip(self.looks(blocks, texts) + given, -20, 20)

    def labels(self, blocks: list[Block], texts: list[str]) -> list[bool]:
        """Which blocks are content."""
        z = self.log_odds(blocks, texts).tolist()
        return min_cut([max(0.0, x) for x in z], [max(0.0, -x) for x in z], [(a, b, self.lambdas[kind]) for a, b, kind in edges_of(blocks)])


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; the rest of the capacities is symmetric. Blocking flows over level graphs."""
    n, tiny = len(source), 1e-9
    # flow through one node at once: what is left is an excess or a deficit
    excess = [a - b for a, b in zip(source, sink)]
    cap: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        cap[a][b] = cap[a].get(b, 0.0) + c
        cap[b][a] = cap[b].get(a, 0.0) + c
    while True:
        level = [-1] * n
        front = [i for i in range(n) if excess[i] > tiny]
        for i in front:
            level[i] = 0
        starts, reached, depth = front, False, 0
        while front and not reached:
            depth += 1
            after = []
            for i in front:
                for j, c in cap[i].items():
                    if c > tiny and level[j] < 0:
                        level[j] = depth
                        after.append(j)
                        reached = reached or excess[j] < -tiny
            front = after
        if not reached:
            return [x >= 0 for x in level]
        rest = [None if x < 0 else iter([j for j in cap[i] if level[j] == x + 1]) for i, x in enumerate(level)]
        head: list[int | None] = [next(it, None) if it else None for it in rest]
        for start in starts:
            path = [start]
            while path and excess[start] > tiny:
                i = path[-1]
                if excess[i] < -tiny:
                    push = min(excess[start], -excess[i], *(cap[a][b] for a, b in zip(path, path[1:])))
                    excess[start] -= push
                    excess[i] += push
                    for a, b in zip(path, path[1:]):
                        cap[a][b] -= push
                        cap[b][a] += push
                    path = path[:1]
                elif head[i] is None:
                    path.pop()
                    if path:
                        head[path[-1]] = next(rest[path[-1]], None)
                elif cap[i][head[i]] > tiny:
                    path.append(head[i])
                else:
                    head[i] = next(rest[i], None)


def read_blocks(page: str) -> tuple[list[Block], list[str]]:
    pairs = [(b, t) for b in blocks_of(page) if (t := clean(b))]
    return [b for b, _ in pairs], [t for _, t in pairs]


def extract(page: str, model: Model) -> str:
    blocks, texts = read_blocks(page)
    return "\n".join(t for t, keep in zip(texts, model.labels(blocks, texts)) if keep) if blocks else ""


def inside(block: Block) -> bool:
    return any(t == "article" for _, t in block.tags)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; the ridge is on standardised features."""
    mean, dev = x.mean(0), x.std(0)
    keep = dev > 1e-9
    z = np.column_stack([np.ones(len(x)), (x[:, keep] - mean[keep]) / dev[keep]])
    pull = np.diag(np.r_[1e-6, np.full(keep.sum(), ridge)])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
    out = np.zeros(x.shape[1])
    out[keep] = w[1:] / dev[keep]
    out[0] = w[0] - (out[keep] * mean[keep]).sum()  # the first feature is 1
    return out


def fit_looks(pages: list[str], most: float = 1.5) -> tuple[np.ndarray | None, tuple[float, ...]]:
    """Weights of features and strengths of edges, from pages that mark an article."""
    x, y, pairs = [], [], np.ones((len(LAMBDAS), 2))
    for page in pages:
        blocks, texts = read_blocks(page)
        label = [inside(b) for b in blocks]
        if any(label) and not all(label):
            x += [features(blocks, texts), features(blocks, texts, bare=True)]  # so that elements don't stand in for all else
            y += label + label
            for a, b, kind in edges_of(blocks):
                pairs[kind, int(label[a] == label[b])] += 1
    if not x:
        return None, LAMBDAS
    lambdas = np.clip(0.5 * np.log(pairs[:, 1] / pairs[:, 0]), 0.0, most)
    return regression(np.concatenate(x), np.array(y, float)), tuple(lambdas.tolist())


def fit(pages: DataFrame, html_col: str = "html", smooth: float = 10.0, fitted: int = FITTED) -> Model:
    """Learns from the pages that mark an article: names from all, looks from at most ``fitted``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((NAMES_HELD, 2), np.int64)
        for pdf in frames:
            for page in pdf["html"]:
                blocks = blocks_of(page)
                if not any(map(inside, blocks)):
                    continue
                around = wrappers(blocks)
                for b in blocks:
                    if any(t == "form" and i not in around for i, t in b.tags):
                        continue  # a form says nothing of what its place is for
                    for w in b.words:
                        found[held_name(w), int(inside(b))] += 1
        some = np.flatnonzero(found.sum(1))
        yield pd.DataFrame({"name": some, "outside": found[some, 0], "inside": found[some, 1]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, lambdas = fit_looks([page for pdf in frames for page in pdf["html"]])
        yield pd.DataFrame({"weights": [None if weights is None else weights.tolist()], "lambdas": [list(lambdas)]})

    named = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("html")).where(F.col("html").rlike("(?i)<article"))
    counts = named.mapInPandas(count, "name int, outside long, inside long").groupBy("name").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    names, total = np.zeros((NAMES_HELD, 2)), np.zeros(2)
    for r in counts.collect():  # at most NAMES_HELD rows of three numbers
        names[r["name"]] = r["outside"], r["inside"]
    total = np.maximum(1.0, names.sum(0))
    odds = np.log((names[:, 1] + smooth * total[1] / total.sum()) / (names[:, 0] + smooth * total[0] / total.sum())) - np.log(total[1] / total[0])
    # a documented bound on labelled rows: the pages of the smallest hashes; only hashes are sorted, equal pages count once
    hashed = named.withColumn("hash", F.xxhash64("html"))
    most = hashed.select("hash").distinct().orderBy("hash").limit(fitted).agg(F.max("hash")).first()[0]
    sample = hashed.where(F.col("hash") <= most).groupBy("hash").agg(F.min("html").alias("html")) if most is not None else named.limit(0)
    looks = sample.select("html").repartition(1).mapInPandas(learn, "weights array<double>, lambdas array<double>").first()
    if looks is None:
        return Model()
    return Model(np.clip(odds, -3, 3).astype(np.float32), None if looks["weights"] is None else np.array(looks["weights"]), tuple(looks["lambdas"]))


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [extract(h, model) for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(fill, "id string, url string, text string, n_chars long").withColumn("id", F.col("id").cast("long"))
