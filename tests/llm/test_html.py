import html as references
import random
import re
import time
from collections import Counter

from lumenfold.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body class="single">
<header class="site-header"><a href="/">Home</a> <h2>Site name</h2></header>
<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site work for you and for our partners, please agree.</p></div>
<div class="layout"><div class="post-content"><h1>A &amp; B</h1><p>First   para with <b>bold</b>, <a href="#">a link</a> &lt;tag&gt; &copy 2024.</p>
<p>Line one<br>line two<p>Unclosed para
<ul><li>item one</li><li>item two</li></ul>
<div class="ad-box">Buy now cheap things today</div>
<blockquote>Quoted words here.</blockquote><table><tr><td>c1</td><td>c2</td></tr></table><p>ok.</p></div>
<aside class="sidebar"><h3>Related</h3><p>Some other story that is long enough to look like a paragraph of an article, really.</p></aside>
<form><p>Your mail</p><input><button>Send</button></form>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I think that this article is very good and I would like to say so at length.</p></div></section></div>
<footer><p>&copy; 2024 Someone, all rights reserved.</p></footer></body></html>"""
TEXT = "A & B\nFirst para with bold, a link <tag> © 2024.\nLine one line two\nUnclosed para\nitem one\nitem two\nQuoted words here.\nc1\nc2\nok."


def test_page_without_an_article():
    assert html.extract(PAGE, html.Model()) == TEXT
    assert html.extract(PAGE.replace('class="post-content"', "").replace('class="layout"', ""), html.Model()).startswith("A & B\nFirst")
    article = PAGE.replace('<div class="post-content">', "<article>").replace("ok.</p></div>", "ok.</p></article>")
    assert html.extract(article, html.Model()) == TEXT


def test_odd_input():
    for page in ("", "   ", "<", "<<<>>>", "<script>", "<p", "&amp", "<!-- x", "</p></div>", "<article>" * 3000):
        assert isinstance(html.extract(page, html.Model()), str)
    assert html.extract("<article><p>" + "a < b " * 20000 + "</p></article>", html.Model()) == ("a < b " * 20000).strip()


def brute_cut(source, sink, edges):
    n = len(source)
    return min(
        sum(sink[i] if m >> i & 1 else source[i] for i in range(n)) + sum(c for a, b, c in edges if (m >> a ^ m >> b) & 1)
        for m in range(1 << n)
    )


def test_minimum_cut_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        source, sink = [rng.random() * rng.randint(0, 3) for _ in range(n)], [rng.random() * rng.randint(0, 3) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cut = html.min_cut(source, sink, edges)
        cost = sum(sink[i] if cut[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if cut[a] != cut[b])
        assert abs(cost - brute_cut(source, sink, edges)) < 1e-6


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.main_text(pages, html.fit(pages)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html.main_text(pages.limit(0), html.fit(pages.limit(0))).count() == 0


def test_whole_pages_of_the_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["id"]: r["text"] for r in html.main_text(pages, html.fit(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (references.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(t for b in blocks if (t := " ".join(b.split())))


def test_implied_ends_and_forms():
    text = "The quick report says a great deal about the town, its river and the long bridge over it, which was rebuilt. " * 3
    want, p = text.strip(), f"<p>{text}</p>"
    head = "<html><head><title>T</title><meta charset=utf-8><style>a{}</style>"
    for page in (f"{head}<body><article>{p}</article></body>", f"{head}<article>{p}</article>", f"{head}<noscript><link><body><article>{p}</article>", f"{head}</head><body><article>{p}</article>"):
        assert html.extract(page, html.Model()) == want
    for control in ("<label>Mail", "<button type=submit>Send", "<select><option>One<option>Two", "<label for=a>A<label>B"):
        assert html.extract(f"<body>{control}<article>{p}</article><label>x</label>", html.Model()) == want
    assert html.extract(f"<body><article>{p}<button><div>Send {text}</div></button></article>", html.Model()) == want  # with an end tag
    assert html.extract(f"<body><form id=aspnetForm><div class=content>{p}</div><nav>Home</nav></form></body>", html.Model()) == want
    assert html.extract(f"<body><form><main>{p}</main><footer>{text * 4}</footer></form></body>", html.Model()) == want
    assert html.extract(f"<body><article>{p}{p}<form><p>Write what you think of this</p></form></article></body>", html.Model()) == want + "\n" + want


def test_a_page_of_many_blocks_takes_time_about_in_proportion():
    rng = random.Random(5)
    n = 50_000
    source, sink = [3 * rng.random() * (i // 7 % 3 == 0) for i in range(n)], [3 * rng.random() * (i // 5 % 2) for i in range(n)]
    edges = [(i, i + 1, 1.5 * rng.random()) for i in range(n - 1)] + [(i, i + rng.randint(2, 9), 0.5) for i in range(0, n - 10, 3)]
    began = time.perf_counter()
    assert len(html.min_cut(source, sink, edges)) == n
    page = "<body><nav>" + "<a href=x>Go</a><p>" * 2000 + "</nav><article>" + "<p>Some words of a text that has an end.</p>" * 48_000 + "</article></body>"
    assert html.extract(page, html.Model()).count("Some words") == 48_000
    assert time.perf_counter() - began < 60


def bare(page):
    """Without names, and with div for all elements that mark content or boilerplate."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def plain(page):
    return re.sub(r"<(/?)(p|h[1-6]|ul|ol|li|blockquote|table|tr|td)\b", r"<\1div", bare(page))


def token_f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_pages_whose_marks_are_hidden(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages)
    assert model.weights is not None and max(model.lambdas) > 1
    given = [r["html"] for r in pages.collect()]
    whole = [html.extract(page, model) for page in given]
    for hide, least in ((bare, 0.99), (plain, 0.95)):
        assert sum(token_f1(html.extract(hide(p), model), t) for p, t in zip(given, whole)) / len(given) > least
    changed = 0
    for page in map(plain, given):
        blocks, texts = html.read_blocks(page)
        changed += [z > 0 for z in model.log_odds(blocks, texts)] != model.labels(blocks, texts)
    assert changed > 0.05 * len(given)  # pages where the cut says other than the classifier alone


def test_names_are_learnt_whole(spark):
    name = "q" * 60
    page = lambda a, b: f"<body><div class={a}><p>One two three.</p></div><article><p class={b}>Four five six seven.</p></article></body>"
    rows = [(i, page(name + "x", name + "y")) for i in range(40)]
    model = html.fit(spark.createDataFrame(rows, "page_id long, html string"))
    assert model.names[html.held_name(name + "x")] < -1 and model.names[html.held_name(name + "y")] > 1
