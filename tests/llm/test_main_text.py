import math
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from voxtally.llm import main_text as mt
from voxtally.llm.main_text import Page, extract, judge, judged_branches


def text(page):
    return Page(page).main_text({})


def test_unclosed_tags_raw_text_and_references():
    page = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">buy
now</div><article><h1>Title &amp; more</h1><p><b>First.<br><p>Second&nbsp;one<i>x</i>.</p>\n<p>3 &lt; 4</p></article><footer>&copy; me</footer>"""
    assert text(page) == "Title & more First. Second onex. 3 < 4"


def test_what_is_left_out():
    page = """<body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">accept</div><main><article class="post with-comments">
<header class="entry-header"><h1>Head</h1><span>by me</span></header><p>One</p><aside>side</aside><div class="adSlot">ad</div><form>f</form>
<p hidden>no</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre><section id="comments"><p>rude</p></section></article></main>
<div role="complementary">x</div><div class="related-posts"><article><p>other</p></article></div><footer>f</footer></body>"""
    assert text(page) == "Head One a b c d e f"
    assert text("<div><p>a</p><p class=comment>b</p>c</div>") == "a c"
    assert text("") == text("   ") == text(None) == ""
    assert text("plain < text &amp; 1<2") == "plain < text & 1<2"
    assert text("<p>a<script>x") == "a" and text("<p>a<!-- b") == "a" and text('<p title="a>b">c') == "c"
    assert text("<div>" * 30_000 + "deep") == "deep"
    assert text("<article><p>a</article><article><p>b</article>") == "a b"


class PlainBranches(HTMLParser):
    """The branches of a well-formed page without marks, by the standard library's parser: path -> (style, texts)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found = [((), [], [])], []
        self.feed(page or "")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        label = tag + (f".{' '.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}" if a else "")
        self.open[-1][1].append(tag)
        self.open.append((self.open[-1][0] + (label,), [], []))

    def handle_endtag(self, tag):
        self.found.append(self.open.pop())

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append("#")
            self.open[-1][2].append(" ".join(data.split()))


def plain_codes(pages):
    """(host, path) -> code, counted and judged without the module's parser, walk or rows."""
    seen, styles, texts = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for i, (url, html) in enumerate(pages):
        host = url.split("/")[2] if url else ""
        for path, style, own in PlainBranches(html).found:
            seen[host, path].add(i)
            styles[host, path][tuple(style)].add(i)
            for t in own if path != ("body",) else ():
                texts[host, path][t].add(i)
    out = {}
    for key, on in seen.items():
        m, counts, heard = len(on), [len(x) for x in styles[key].values()], [len(x) for x in texts[key].values()]
        p = [c / sum(counts) for c in counts]
        presentation = min(1, -sum(x * math.log(x) for x in p) / math.log(min(max(m, 2), 8)))
        content = 1 - sum(c * min(1, math.log(c) / math.log(8)) for c in heard) / sum(heard) if heard else 1
        shape = (1 - 0.9 ** len(counts)) * presentation
        whole = shape + 0.9 ** len(counts) * content
        able = bool(heard) and m > 1
        code = (shape >= 0.5) + 2 * (able and whole < 0.8 * (1 - 2 / m)) + 4 * (able and whole < 0.25)
        if code:
            key_now = 0
            for label in key[1]:
                key_now = mt.branch_key(label, key_now)
            out[key[0], key_now] = code
    return out


def site(r, n):
    word = lambda: "".join(r.choices("abcdefg", k=5))
    pages = []
    for i in range(n):
        host = r.choice(["http://big.example/", "http://big.example/", "http://small.example/"])
        body = "".join(f"<p>{' '.join(word() for _ in range(9))}</p>" for _ in range(r.randint(1, 5)))
        box = r.choice(["<p>Read our great terms</p>", "<p>Read our great terms</p>", "<p>Second slogan</p>"])
        pages.append((host + str(i), f"<body><div class=blurb{'' if i % 9 else ' x'}>{box}</div><div class=text>{body}</div><div class=end>All the best from us</div></body>"))
    return pages


@pytest.mark.parametrize("limit", [100_000, 0])
def test_site_tree(spark, monkeypatch, limit):
    monkeypatch.setattr(mt, "BROADCAST", limit)
    pages = site(random.Random(2), 120) + [("http://one.example/", "<body><div class=end>All the best from us</div></body>"), (None, None)]
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    want = plain_codes(pages)
    assert {(x.host, x.branch): x.code for x in judged_branches(df).collect()} == want
    assert any(code & mt.STRONG for code in want.values())
    got = {x.page_id: x for x in extract(df).collect()}
    assert len(got) == len(pages)
    for i, (url, html) in enumerate(pages):
        if url and "one" not in url:
            assert got[i].text == " ".join(html.split("class=text>")[1].split("</div>")[0].replace("<p>", " ").replace("</p>", " ").split())
        assert got[i].n_chars == len(got[i].text) and got[i].url == url
    assert got[120].text == "All the best from us" and got[121].text == ""
    assert extract(df.limit(0)).count() == 0


def test_mirrored_articles_stay(spark):
    page = "<body><article><h1>Same</h1><p>Same text on every mirror.</p><p class=note>Sign here.</p></article></body>"
    df = spark.createDataFrame([(i, "http://m.example/", page) for i in range(12)], "page_id long, url string, html string")
    assert {x.text for x in extract(df).collect()} == {"Same Same text on every mirror."}


def test_importance():
    assert judge(1, {1: 1}, {5: 1}) == (0.9, 0)
    assert judge(8, {1: 8}, {5: 8}) == (0, mt.STRONG | mt.WEAK)
    assert judge(8, {1: 8}, {i: 1 for i in range(8)}) == (pytest.approx(0.9), 0)
    assert judge(2, {1: 2}, {5: 2})[1] == judge(3, {1: 3}, {5: 3})[1] == 0  # few pages show little
    assert judge(4, {1: 4}, {5: 4})[1] == mt.WEAK
    varied = {i: 1 for i in range(40)}
    assert judge(40, varied, varied) == (pytest.approx(1.0), mt.HOLDS)
    # the same share of repeats is judged alike on a host of any size above the smallest
    assert judge(40, {1: 40}, {i: 8 for i in range(5)})[1] == judge(40_000, {1: 40_000}, {i: 8 for i in range(5000)})[1] == mt.STRONG | mt.WEAK


def test_the_tree_alone_takes_templates_out(spark):
    """Without any hint: menus, slogans and footers that return go, articles of varied shape stay whole, also their repeated words."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    slogans = [" ".join(word() for _ in range(6)) for _ in range(4)]
    pages, want = [], []
    for i in range(60):
        body = [" ".join(word() for _ in range(8)) for _ in range(r.randint(1, 12))]
        want.append(" ".join(body))
        rows = "".join(f"<p>{t}</p>" for t in body)
        pages.append((i, f"http://a.example/{i}", f"<body><div><ul><li>Home</li><li>About</li></ul></div><div class=x1>{r.choice(slogans)} <b>now</b></div><section>{rows}</section><div class=z>All rights <i>kept</i></div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract(df, hints=False).collect()}
    assert [got[i] for i in range(60)] == want
    # on a host of identical pages without marks the tree can't tell
    same = spark.createDataFrame([(i, "http://b.example/", "<body><div><p>One text alone.</p></div></body>") for i in range(20)], "page_id long, url string, html string")
    assert {x.text for x in extract(same, hints=False).collect()} == {"One text alone."}


def test_a_class_that_only_holds_a_hint_is_no_hint():
    for name in ("share-price", "content-notice", "login-guide", "form-analysis", "widget-review", "commented"):
        assert text(f'<article><div class="{name}"><p>Shares rose.</p></div></article>') == "Shares rose.", name
    for name in ("share-buttons", "cookie-notice", "site-footer", "ad-728x90", "adSlot", "related-posts", "article-comments", "newsletter", "x login-form"):
        assert text(f'<article><div class="{name}"><p>Shares rose.</p></div><p>y</p></article>') == "y", name
    assert text("<form id=aspnetForm><nav>n</nav><article><p>a</p><form>f</form></article></form>") == "a"


def test_deep_and_long_pages_take_linear_time(spark):
    deep = "<body>" + "".join(f"<div>t{i} " for i in range(20_000))
    wide = "<body>" + "<p>some words</p>" * 100_000
    df = spark.createDataFrame([(i, "http://d.example/", h) for i, h in enumerate([deep, deep, wide])], "page_id long, url string, html string")
    began = time.monotonic()
    got = {x.page_id: x for x in extract(df).collect()}
    assert time.monotonic() - began < 60
    assert got[0].text == " ".join(f"t{i}" for i in range(20_000)) and got[2].n_chars == 100_000 * 11 - 1


@pytest.mark.parametrize("quote", ["\"", "'"])
def test_long_attribute_values(quote):
    value = "a" * 6000 + "<p>junk</p> leak"
    assert text(f"<div data-x={quote}{value}{quote}><p>real</p></div>") == "real"
    assert text(f"<div data-x = {quote}{value}{quote} class=b>real</div>") == "real"
    # a quote that never closes, or that stands elsewhere than behind an equals sign, ends with its tag
    assert text(f"<p>a<b title={quote}x>b</b> c</p>") == "ab c"
    assert text(f"<p>a<i b{quote}>b</i> {value[:50]} {quote}c</p>").startswith("ab ")


def test_unended_tags_and_stray_end_tags_take_linear_time():
    from voxtally.llm.dom import parse

    began = time.perf_counter()
    for page in (" if a <b and c" * 50_000, "x > " + " if a <b and c" * 50_000, "<b>" * 20_000 + "</i>" * 20_000 + "<div>" * 20_000 + "</section>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<ul>" + "<b>" * 20_000 + "<li>" * 20_000, "<!-- " * 50_000):
        parse(page)
    assert time.perf_counter() - began < 10
    assert [getattr(n, "name", n) for n in parse("<p>x<div>y</b></p>z").children] == ["p", "div"]
    assert parse("a <b and <!-- c > d").children[0] == "a "
