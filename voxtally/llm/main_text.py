"""Main text of pages by a site style tree.

Pages of one host are merged into one tree whose nodes are branches (element names with their classes and ids from the body down). For
each branch the tree counts, over the host's pages, its styles (sequences of child elements) and the texts that stand directly in it.
A branch's importance is composed of

* presentation: the entropy of its styles over its m pages, to base min(m, `FULL`), 1 at most;
* content: 1 less the mean entropy of its texts; a text on n pages has entropy log n to base `FULL`, 1 at most.

With l styles it is (1 - g^l) presentation + g^l content, g = `DAMPING`. As `FULL` is fixed, a verdict doesn't move with the size of a host, and
the few repeats that small hosts can show weigh little. A branch whose presentation alone gives `RICH` or more holds what differs from page to page. A
branch's texts, with the inline elements among them, are taken out of each page if its importance is below `LEAST`, and outside of rich branches and marked articles already if
it is below `REPEATED` (1 - 2/m), which asks more of branches that few pages have. Branches are judged from two pages on. Where this leaves
nothing of a page, and its host has no rich branch, the tree has seen one text alone and can't tell: the page keeps its texts.

The tree sees templates. Menus, adverts or reader comments that differ on each page look like articles to it, so what elements say
themselves settles those: name, role, or a class or id that as a whole names a menu, header, footer, sidebar, notice, advert, form or reader
comments (words of place or shape may stand beside, other words may not: share-price is no sharing). Where a page
marks its article (article, main or their roles), the rest of the page is not main text, and the marked element itself and its
plain paragraphs are never judged by the tree, so that mirrored articles stay whole. In a header inside the article, headings stay.
A form around a marked article is a frame.

Texts are decoded, white space within a block becomes one space, blocks are joined by one space in page order.

Null html is an empty page; a null or odd url is a host of its own name, "". Equal rows are treated alike; other columns are ignored. An
empty table gives no rows. A page gives a row for each of its branches, styles and texts, however deep they are nested. Only counts are
shuffled; the list of judged branches is broadcast up to `BROADCAST` rows, beyond that pages are joined to it by host
with `SALTS` copies, so that no task gets a whole large host.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, checkpointed, map_arrow, map_rows, to_batches, values
from voxtally.llm.dom import BLOCK, RAW, Node, parse

DAMPING, FULL = 0.9, 8
RICH, LEAST, REPEATED = 0.5, 0.25, 0.8
BROADCAST, SALTS = 100_000, 32

#: Elements that hold no main text, and roles, class and id words that say so (fixed values).
OUT = RAW | frozenset("head nav footer aside form button select input template svg math canvas audio video object embed dialog menu search datalist label".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot banner sponsor sponsored promo promotion nav navbar topnav subnav"
    " sidenav navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside rail widget widgets cookie cookies consent gdpr ccpa notice notices"
    " notification alert popup modal overlay lightbox newsletter subscribe subscription signup signin login register share sharing social socials related"
    " recommended recommendations comments comment commentlist disqus replies reply respond pagination pager toolbar skip form search searchbox paywall"
    " disclaimer copyright".split()
)
#: Words of place that may stand before those, and words of shape or part that may follow them, in a class or id (fixed values).
PLACES = frozenset("site page main top bottom left right global primary secondary post entry article blog user reader sticky fixed floating mobile desktop google dfp gpt in on js the our".split())
SHAPES = frozenset(
    "box block container wrapper wrap inner outer list lists item items section area bar panel slot unit zone space placement leaderboard mpu media icon icons button"
    " buttons btn link links text content body title heading head header row column col group card cards image label message info law policy settings cta to posts"
    " articles stories story reading news topics products trail toggle top bottom left right main this us form".split()
)
OTHER_ARTICLES = frozenset("comment comments reply ad ads advert promo sponsored related".split())
HEADER_WORDS = frozenset({"header", "heading", "titlebar"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"})
ROOT_ROLES = frozenset({"main", "article"})

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _is_other(attributes: dict[str, str]) -> bool:
    """Whether an article or main is a reader's comment or an advert: by a whole class or id, as their names also qualify articles."""
    return any(c.split("-")[0].split("_")[0] in OTHER_ARTICLES for c in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def _says(attributes: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or the id, as a whole, is one of the words, with words of place before and of shape or part behind."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [w.lower() for w in _WORD.findall(_SIZE.sub("", name))]
        while parts and parts[0] in PLACES and parts[0] not in words:
            parts = parts[1:]
        if parts and parts[0] in words and all(w in words or w in SHAPES for w in parts):
            return True
    return False


def _holds_article(node: Node) -> bool:
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if type(child) is not str:
                if child.name in ("article", "main"):
                    return True
                stack.append(child)
    return False


class Page:
    """One parsed page with what is main text by its own marks, and its branches. Without `hints` only what never holds text is left out and
    nothing marks an article, so that the site's tree alone decides."""

    def __init__(self, text: str | None, hints: bool = True):
        self.tree = parse(text or "")
        self.hints = hints
        self.state: dict[int, str] = {}
        self.roots: list[Node] = []
        self._mark(self.tree, False)
        self._find_roots(self.tree)

    def _mark(self, node: Node, inside: bool) -> None:
        """State of each element: 'out', 'head' (only headings count) or nothing. Iterative, for deep trees."""
        stack = [(node, inside)]
        while stack:
            at, inside = stack.pop()
            for child in at.children:
                if type(child) is str:
                    continue
                state, root = self._judge(child, inside)
                if state:
                    self.state[id(child)] = state
                if state != "out":
                    stack.append((child, inside or root))

    def _judge(self, node: Node, inside: bool) -> tuple[str, bool]:
        name = node.name
        if not self.hints:
            return "out" if name in RAW or name == "head" else "", False
        if name in OUT and not (name == "form" and not inside and _holds_article(node)):
            return "out", False
        if not node.attributes:
            return ("head" if inside else "out") if name == "header" else "", name in ("article", "main")
        a = node.get()
        role = a.get("role", "").lower()
        frame = name in ("html", "body", "main", "form")
        root = name in ("article", "main") or role in ROOT_ROLES or a.get("itemprop", "").lower() == "articlebody"
        if not frame and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", ""))):
            return "out", False
        if not frame and (role in OUT_ROLES or (_is_other(a) if root else _says(a, OUT_WORDS))):
            return "out", False
        if not frame and not root and (name == "header" or _says(a, HEADER_WORDS)):
            return "head" if inside else "out", False
        return "", root

    def _find_roots(self, node: Node) -> None:
        """The outermost marked articles; a main that holds articles gives way to them."""
        found: list[tuple[Node, bool, bool]] = []  # with whether it is a main, and whether a root of the other kind or its own is above
        stack: list[tuple[Node, bool, bool]] = [(node, False, False)]
        while stack:
            at, below_main, below_article = stack.pop()
            if at is not node and self._judge(at, True)[1]:
                main = at.name == "main" or at.get().get("role", "").lower() == "main"
                found.append((at, main, below_main or below_article if main else below_article))
                below_main, below_article = below_main or main, below_article or not main
            for child in reversed(at.children):
                if type(child) is not str and self.state.get(id(child)) != "out":
                    stack.append((child, below_main, below_article))
        articles = [n for n, main, below in found if not main and not below]
        self.roots = articles or [n for n, main, below in found if main and not below]

    def walk(self) -> Iterator[tuple[Node, int, bool, bool]]:
        """Elements from the body down with the key of their branch, whether the site's tree may judge them, and whether they are inside a
        marked article. A key is made from the key above and the element's label, so that deep pages cost no long paths."""
        roots = {id(n) for n in self.roots}
        stack: list[tuple[Node, int, bool]] = [(self.tree, 0, False)]
        while stack:
            node, key, inside = stack.pop()
            if node is not self.tree:
                yield node, key, not (id(node) in roots or inside and not _named(node) or node.name in ("html", "body")), inside
            inside = inside or id(node) in roots
            for child in reversed(node.children):
                if type(child) is not str and child.name not in RAW and child.name != "head":
                    stack.append((child, branch_key(_label(child), key), inside))

    def main_text(self, codes: dict[int, int]) -> str:
        """`codes`: verdicts on branches of the page's host."""
        gone: set[int] = set()
        if codes:
            rich: set[int] = set()  # elements in a rich branch
            for node, key, may, inside in self.walk():
                code = codes.get(key, 0)
                above = inside or id(node.parent) in rich
                if may and (code & STRONG or code & WEAK and not above):
                    gone.add(id(node))
                if above or code & HOLDS and node.name not in ("html", "body"):
                    rich.add(id(node))
        text = self._text(gone)
        return text if text or not gone or any(c & HOLDS for c in codes.values()) else self._text(set())

    def _text(self, gone: set[int]) -> str:
        out: list[str] = []
        for root in self.roots or [self.tree]:
            self._blocks(root, gone, out)
        return " ".join(t for block in out if (t := " ".join(block.split())))

    def _blocks(self, root: Node, gone: set[int], out: list[str]) -> None:
        inline: list[str] = []

        def end() -> None:
            if inline:
                out.append("".join(inline))
                inline.clear()

        # an item, whether only headings count, and whether the texts around it are taken out
        stack: list[tuple[object, bool, bool]] = [(root, False, False)]
        while stack:
            item, head, cut = stack.pop()
            if item is None:
                end()
            elif type(item) is str:
                if not head and not cut:
                    inline.append(item)
            elif item.name in ("br", "hr", "wbr"):
                inline.append("" if item.name == "wbr" else " ")
            elif self.state.get(id(item)) != "out":
                head = (head or self.state.get(id(item)) == "head") and item.name not in HEADINGS
                block = item.name in BLOCK
                cut = id(item) in gone or cut and not block
                if block:
                    end()
                    stack.append((None, head, cut))
                stack.extend((c, head, cut) for c in reversed(item.children))
        end()


def _named(node: Node) -> bool:
    return "class" in node.attributes or "id" in node.attributes


def _label(node: Node) -> str:
    if not _named(node):
        return node.name
    a = node.get()
    return _DIGITS.sub("0", f"{node.name}.{' '.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}")


def branch_key(text: str, above: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, above & 0xFFFF_FFFF_FFFF_FFFF) - (1 << 63)


#: Kinds of rows that a page gives to its host's tree.
SEEN, STYLE, TEXT = 0, 1, 2
#: Verdicts on a branch; bits of a code.
HOLDS, WEAK, STRONG = 1, 2, 4


def tree_rows(page: Page) -> Iterator[tuple[int, int, int]]:
    """(branch, kind, what) of every branch: that it is there, its styles, and, if it may be judged, the texts directly in it."""
    rows: set[tuple[int, int, int]] = set()
    for node, key, may, _ in page.walk():
        style = " ".join("#" if type(c) is str else c.name for c in node.children if type(c) is not str or c.strip())
        rows.add((key, SEEN, 0))
        rows.add((key, STYLE, branch_key(style)))
        if may:
            rows.update((key, TEXT, branch_key(t)) for c in node.children if type(c) is str and (t := " ".join(c.split())))
    yield from rows


def judge(pages: int, styles: dict[int, int], texts: dict[int, int]) -> tuple[float, int]:
    """Importance and verdicts of a branch; styles and texts: on how many pages each stands."""
    total, heard = sum(styles.values()), sum(texts.values())
    entropy = -sum(n / total * math.log(n / total) for n in styles.values()) / math.log(min(max(pages, 2), FULL))
    content = 1 - sum(n * min(1.0, math.log(n, FULL)) for n in texts.values()) / heard if heard else 1.0
    share = DAMPING ** len(styles)
    shape = (1 - share) * min(1.0, entropy)
    whole = shape + share * content
    code = HOLDS * (shape >= RICH)
    if heard and pages > 1:
        code |= STRONG * (whole < LEAST) | WEAK * (whole < REPEATED * (1 - 2 / pages))
    return whole, code


def judged_branches(pages: DataFrame, url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """host, branch, code: the branches of each host on which there is a verdict."""
    schema = "host string, branch long, kind int, what long, n long"
    out = arrow_schema(pages.sparkSession, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            held: Counter = Counter()
            for host, text in values(batches, 100):
                held.update((host, *r) for r in tree_rows(Page(text, hints)))
                if len(held) > 50_000:
                    yield from ((*k, n) for k, n in held.items())
                    held.clear()
            yield from ((*k, n) for k, n in held.items())

        yield from to_batches(counted(), out)

    table = map_arrow(pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")), rows, schema)
    each = table.groupBy("host", "branch", "kind", "what").agg(F.sum("n").alias("n"))
    n = F.col("n")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
    whole = each.groupBy("host", "branch").agg(
        of(SEEN, n).alias("pages"),
        of(STYLE, n).alias("styled"),
        of(STYLE, n * F.log("n")).alias("style_logs"),
        F.count_if(F.col("kind") == STYLE).alias("styles"),
        of(TEXT, n).alias("heard"),
        of(TEXT, n * F.least(F.lit(1.0), F.log("n") / math.log(FULL))).alias("text_logs"),
    )
    entropy = (F.log("styled") - F.col("style_logs") / F.col("styled")) / F.log(F.least(F.greatest("pages", F.lit(2.0)), F.lit(float(FULL))))
    share = F.pow(F.lit(DAMPING), F.col("styles"))
    whole = whole.withColumn("shape", (1 - share) * F.least(F.lit(1.0), entropy))
    whole = whole.withColumn("importance", F.col("shape") + share * F.when(F.col("heard") > 0, 1 - F.col("text_logs") / F.col("heard")).otherwise(1.0))
    judged = (F.col("heard") > 0) & (F.col("pages") > 1)
    tests = {HOLDS: F.col("shape") >= RICH, STRONG: judged & (F.col("importance") < LEAST), WEAK: judged & (F.col("importance") < REPEATED * (1 - 2 / F.col("pages")))}
    code = sum((F.when(test, bit).otherwise(0) for bit, test in tests.items()), F.lit(0))
    return whole.select("host", "branch", code.cast("int").alias("code")).where("code > 0")


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), _HOST, 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every whole page. Without `hints` the site's tree alone decides."""
    judged = checkpointed(judged_branches(pages, url_col, html_col, hints))
    n = judged.count()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    by_host: dict[str, dict[int, int]] = defaultdict(dict)
    if n <= BROADCAST:
        for r in judged.collect():  # at most BROADCAST rows
            by_host[r["host"]][r["branch"]] = r["code"]
        rows = rows.withColumn("branches", F.lit(None).cast("array<long>")).withColumn("codes", F.lit(None).cast("array<int>"))
    else:
        one = F.struct("branch", "code")
        lists = judged.groupBy("host").agg(F.collect_list(one).alias("all")).select("host", F.col("all.branch").alias("branches"), F.col("all.code").alias("codes"))  # as many as a template has branches
        lists = lists.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "branches", "codes")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left")
    shared = pages.sparkSession.sparkContext.broadcast(dict(by_host))

    def make():
        known = shared.value

        def one(row):
            page_id, url, host, text, branches, codes = row
            main = Page(text, hints).main_text(known.get(host) or dict(zip(branches or (), codes or (), strict=True)))
            return page_id, url, main, len(main)

        return one

    return map_rows(rows.select("page_id", "url", "host", "html", "branches", "codes"), "page_id long, url string, text string, n_chars long", make)
