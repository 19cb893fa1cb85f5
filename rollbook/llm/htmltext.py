"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link density, those of the blocks
before and after it, and what its page says of it: whether it lies in an element that is furniture by its tag or role or by a
name in class or id (`apart`), in one whose name may mean furniture (`doubtful`), in an article or main element, in a heading. A
decision tree, grown by Gini impurity on the blocks of the small labelled pages below, tells content from the rest; no rule
decides beside it. Scripts, styles, comments and the like are no blocks at all, nor is what an inline element holds that is furniture
by its tag, role or name or is hidden (a button or an advert inside a paragraph): such text is left out of its block.

An element that only wraps the page is no furniture, whatever it is called: a form, or an element of a doubtful name, that holds
an article or main element, or most of the page's words outside links.

Inside a block character references are decoded and white space becomes one space; the blocks kept are joined in page order by
a line feed. Line breaks (br) are white space, not block ends.

Scale: a map over the pages; no shuffle, nothing broadcast but the tree, memory bounded by a page. Time is linear in the page, however deep
its elements are or however many are left open: words are passed up when an element ends, and a block knows only the innermost one.

Defined cases: null and empty html, and pages without content, have empty text; tags left open or cut off are closed by the
page's end; a quote opens a value only after an equals sign; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import map_batches

_INSIDE = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"  # of a tag, up to its end
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style|template|iframe|svg|title|textarea|select|object|canvas|audio|video)\b{_INSIDE}>.*?(?:</\1\s*>|$)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*$",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements by their part in a page.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
APART_TAGS = set("nav aside footer form menu dialog button fieldset label".split())
APART_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# Names in class and id.
APART_NAMES = set("ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead nav navbar navigation newsletter pager pagination paywall popup reply replies respond sidebar sponsored toolbar".split())
DOUBTFUL_NAMES = set("banner disclaimer form header login menu modal notice notices notification promo promoted promotion related share sharing signup social sponsor subscribe subscription widget".split())


@dataclass(eq=False)
class Element:
    """An open element that may be furniture, and the one of that kind around it; words: those outside links that have passed in it."""

    apart: bool
    excused: bool  # whether wrapping an article or most of the page excuses it
    outer: Element | None = None
    words: int = 0
    wraps: bool = False
    in_apart: bool = False  # whether it or one around it is furniture, in_doubt: may be
    in_doubt: bool = False


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    heading: bool
    around: Element | None = None
    apart: bool = False
    doubtful: bool = False


def _furniture(tag: str, attributes: str, in_article: bool) -> Element | None:
    if tag in ("html", "body", "article", "main"):
        return None
    names: set[str] = set()
    roles: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value = value.strip("\"'")
        if (name := name.lower()) == "role":
            roles.update(value.lower().split())
        elif name == "hidden":
            hidden = True
        elif name in ("class", "id"):
            names.update(x.lower() for x in _NAME.findall(value))
    if tag == "form":
        return Element(True, True)
    if tag in APART_TAGS or tag == "header" and not in_article or hidden or roles & APART_ROLES or names & APART_NAMES:
        return Element(True, False)
    return Element(False, True) if names & DOUBTFUL_NAMES else None


def blocks_of(page: str | None) -> list[Block]:
    """The flat text blocks of a page."""
    out: list[Block] = []
    stack: list[tuple[str, Element | None, bool]] = []  # tag, what it is as furniture, whether its text is left out
    elements: list[Element] = []
    opened: Counter = Counter()
    around: Element | None = None
    parts: list[tuple[str, bool]] = []
    left_out = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(entities.unescape(t).split()) for t, a in parts if a)
                words, heading = len(text.split()), any(opened[h] for h in HEADINGS)
                out.append(Block(text, words, min(1.0, linked / words), opened["article"] + opened["main"] > 0, heading, around))
                if around is not None:
                    around.words += max(0, words - linked)
            parts = []

    def close(tag: str) -> None:
        """Ends the innermost open element of that tag and those inside it."""
        nonlocal around, left_out
        while True:
            name, e, hides = stack.pop()
            opened[name] -= 1
            left_out -= hides
            if e is not None:
                if e.outer is not None:
                    e.outer.words += e.words
                    e.outer.wraps |= e.wraps
                around = e.outer
            if name == tag:
                return

    def put(text: str) -> None:
        if not left_out:
            parts.append((text, opened["a"] > 0))

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            put(" ")
        if m[2]:
            if opened[tag]:
                close(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and opened["p"]:  # a block ends a paragraph that is open: no block is open inside one
            close("p")
        if tag in ("article", "main") and around is not None:
            around.wraps = True
        e = _furniture(tag, m[4], opened["article"] + opened["main"] > 0)
        hides = e is not None and e.apart and not e.excused and tag not in BLOCKS
        stack.append((tag, e, hides))
        opened[tag] += 1
        left_out += hides
        if e is not None:
            e.outer, around = around, e
            elements.append(e)
    if at < len(page):
        put(page[at:])
    flush()
    while stack:
        close(stack[-1][0])
    whole = sum(b.words * (1 - b.links) for b in out)
    for e in elements:  # outer ones first
        counts = not (e.excused and (e.wraps or 2 * e.words > whole))
        e.in_apart = counts and e.apart or e.outer is not None and e.outer.in_apart
        e.in_doubt = counts and not e.apart or e.outer is not None and e.outer.in_doubt
    for b in out:
        if b.around is not None:
            b.apart, b.doubtful = b.around.in_apart, b.around.in_doubt
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart", "doubtful", "article", "heading")
_NONE = Block("", 0, 0.0, False, False)


def features_of(blocks: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block."""
    beside = [_NONE, *blocks, _NONE]
    return [(b.words, b.links, a.words, a.links, c.words, c.links, b.apart, b.doubtful, b.article, b.heading) for a, b, c in zip(beside, blocks, beside[2:], strict=False)]


#: The labelled table: small pages, block by block. `p:60/4+` is a paragraph of 60 words, 4 of them in links, that is content;
#: `-` marks the rest, `.name` a class, brackets an element with others inside.
PAGES = (
    # articles that are marked as such
    "nav(ul(li:1/1- li:1/1- li:2/2- li:1/1-)) div.ad:8- article(h1:9+ p:62+ p:140+ p:2+ p:9+ p:46+) footer:11/1-",
    "header(p:3/3- p:6-) main(h1:7+ p:1+ p:230/4+ p:31+ h2:4+ p:80/1+ ul(li:3+ li:12+ li:1+) p:5+) footer(p:14- p:3/3-)",
    "nav(li:2/2- li:1/1-) div.advert:14- article(h1:12+ p:120+ p:300+ p:1+ p:7+) footer:9-",
    "nav(li:1/1-) article(h1:5+ p:18+ aside(h3:2- p:24- p:3/3-) p:70+ div.ad:30- p:22+ p:4+) section#comments(h2:1- p:35- p:8- p:90-) footer:6-",
    "header(h1:2- p:9-) article(header(h1:8+ p:6+) p:55+ blockquote:25+ p:3/1+ p:12+ nav(p:2/2- p:2/2-)) div.sidebar(h3:2- p:40- p:60-)",
    "div:1/1- div:2/2- article(h2:6+ p:400+ p:2+ p:2+ p:2+ p:60+ div:3/3- div:6/6- div:2/2-) div:2/2- div:7-",
    "main(article(h1:4+ p:11+ p:2/2+ p:35/12+ p:8/7+ p:90+) form(p:8- p:25-)) footer:20-",
    "article(h1:10+ div.share(p:3- p:4/4-) p:100+ div.share(p:5-) p:65+ p:6+) aside(p:120- p:45-)",
    "article(p:1+) footer:4-", "article(p:3+) div.cookie:30-", "article(p:14+)", "article(p:2/2+)", "article(h1:5+ p:60+ p:2+)", "article(p:2+ p:3+)", "main(p:30+ p:1+)", "article(h1:4+ p:7+)", "article(p:40+ p:11+)",
    "article(h1:8+ p:80+ p:3/3+ p:150+ p:44+ p:2/2+ p:260+ p:5+)", "nav(li:1/1- li:2/2-) p:6/6- article(p:9/9+ p:180+ ul(li:6/6- li:2/2- li:3/3-) p:205+)",
    "article(h1:3+ div.social-policy(p:75+ p:130+) p:18+)",
    "main(h1:6/6+ p:20/20+ p:45+ p:1+ table(td:2+ td:1+ td:3+ td:1+) p:16+) div:5-",
    "nav(li:1/1- li:1/1-) article(h1:5/5+ p:70+ p:4/4+ p:6+ p:33+ p:12/10+ p:2+ ul(li:2/2- li:3/3- li:4/4- li:2/2-)) div:8-",
    "main(h1:7+ p:90+ ul(li:5/5- li:3/3- li:1/1- li:7/6-) p:120+ p:3+ p:60/2+)",
    "article(h1:9+ p:60+ p:2/2+ p:20+ p:3+ p:50+)", "nav(li:1/1- li:1/1-) article(p:6+ p:1+ p:30+)", "div:1/1- div:2/2- main(h1:3+ p:2+ p:1+ p:75+)",
    "article(h1:7+ p:50+ p:3/3+ p:2+ p:70+)", "nav(li:1/1-) article(p:2+ p:30+ p:4/4+ p:1+)", "nav(li:2/2- li:1/1-) main(p:4+ p:3+)",
    "div:4/4- div:2/2- article(p:25+ p:4+ p:3+ p:90+ p:5/5+ p:8+ p:2+ p:33+) div:3-",
    # articles among plain elements, without a name that helps
    "ul(li:1/1- li:2/2- li:1/1- li:1/1- li:3/3-) h1:8+ p:75+ p:50/3+ p:6+ p:110+ div:9- div:2/2- div:2/2- div:6-",
    "div:3- div:1/1- div:1/1- div:1/1- h1:11+ div:90+ div:38+ div:4+ div:160/5+ h3:2- div:7/7- div:9/9- div:8/8- div:12-",
    "div(div:2/2- div:2/2-) div(h2:6+ p:33+ p:210+ p:8+ p:64+) div(h3:2- p:6/6- p:5/5-) div:10/2-",
    "div:2/2- div:5- div:2/2- h1:5+ p:260+ p:40+ p:3+ p:95+ p:11/11- p:14/12- p:8-",
    "p:2/2- p:4- p:3/3- h2:9+ p:48+ p:29/2+ p:5+ p:57+ h2:4+ p:66+ p:3/3- p:5/5- p:2/2-",
    "div:1/1- div:3/3- h1:6+ p:82+ p:19+ p:3/3+ p:70+ div:4-", "h1:10+ p:55+ p:7+ p:130+ div:9-", "p:200+ p:61+ div:3-", "div:2/2- p:45+ p:120+ div:7-",
    "h1:6+ p:80+ p:4+ p:12+ p:90+ p:5+ p:3+ p:7+ p:45+ div:6-", "div:2/2- div:3/3- h1:4+ p:3+ p:20+ p:55+ p:2+ p:5+ p:70+",
    "div:2/2- div:4- div:16- div:3/3- div:5- div:10- h1:7+ p:64+ p:30+ p:4+ p:18+ p:52+ div:1/1- div:3- div:9-",
    "p:35+ p:80+ p:7+ p:44+", "div:22+ div:120/9+ div:24+", "h1:7+ p:150+", "div:1/1- p:100+ div:1/1-",
    "div:6/6- div:30/21- div:25/22- div:4- div:18/15-", "div:2/2- div:5- div:4- div:3/3- div:8-", "div:1/1- div:9- div:1/1- div:5- div:1/1-",
    # short pages without any furniture, and short paragraphs beside none
    "p:1+", "p:2+", "p:3+", "p:5+", "p:8+", "p:12+", "p:16+", "h1:1+ p:7+", "h1:2+ p:9+", "h1:1+ p:7+ p:5+", "h1:3+ p:12+ p:4+ p:6+", "p:4+ p:3+", "p:9+ p:11+ p:2+", "h1:1+ p:4+ p:15+ p:1+", "h2:2+ p:3+ p:3+", "h1:2+", "h1:6+ p:2+", "p:10+ p:7+ p:18+ p:5+",
    "nav(li:1/1- li:2/2-) h1:2+ p:8+ p:5+ footer:5-", "nav(li:1/1-) p:6+ footer:7-", "header(p:2/2-) h1:1+ p:9+ p:4+ div.sidebar:6-",
    # paragraphs that are plain elements
    "div:1/1- div:2/2- h1:7+ div:85+ div:5+ div:52+ div:8+ div:110/2+ div:3/3- div:4/4- div:4-", "h1:6+ div:90+ div:5+ div:40+ div:9+ div:61+ div:8-", "div:2/2- div:1/1- h1:4+ div:35+ div:8+ div:4+ div:60+ div:2/2- div:5-", "h2:9+ div:130+ div:3+ div:77/3+ div:7+ div:50+ div:2/2- div:3/3-",
    # pages that end with a long paragraph
    "h1:3+ p:70+ p:60+", "p:45+ p:90+ p:75+", "h2:5+ p:64+ p:33+ p:58+", "div:2/2- p:60+ p:80+", "h1:4+ div:70+ div:55+", "div:1/1- h1:6+ p:110+ p:40+", "p:36+ p:52+ p:47+", "h1:5+ p:81+ p:130+",
    # short paragraphs in a row
    "article(h1:6+ p:9+ p:7+ p:14+ p:7+ p:30+ p:6+ p:8+ p:7+ p:11+ p:5+ p:16+ p:8+ p:7+ p:13+ p:7+)", "nav(li:1/1- li:2/2-) article(p:120+ p:9+ p:7+ p:90+ p:10+ p:6+ p:12+ p:8+ p:75+ p:15+ p:7+) footer:8-", "h1:9+ p:100+ p:12+ p:7+ p:8+ p:7+ p:60+ p:16+ p:6+ p:9+ p:7+ div:8-",
    "article(h1:3+ p:16+ p:9+ p:18+ p:12+ p:5+ p:13+ p:1+ p:12+ p:16+ p:9+ p:44+ p:15+ p:31+ p:8+ p:20+ p:1+ p:31+ p:5+ p:15+ p:12+ p:6+ p:11+ p:7+ p:2+ p:25+ p:7+ p:3+ p:18+ p:11+ p:13+)",
    "main(h1:12+ p:1+ p:2+ p:18+ p:8+ p:3+ p:14+ p:15+ p:4+ p:14+ p:5+ p:20+ p:11+ p:31+ p:20+ p:6+ p:2+ p:20+ p:6+ p:18+ p:3+ p:13+ p:31+ p:14+ p:31+ p:16+ p:16+ p:31+ p:13+ p:20+ p:1+)",
    "article(h1:10+ p:3+ p:7+ p:9+ p:12+ p:12+ p:13+ p:10+ p:4+ p:9+ p:8+ p:11+ p:12+ p:12+ p:18+ p:25+ p:18+ p:6+ p:1+ p:13+ p:14+ p:2+ p:18+ p:1+ p:8+ p:14+ p:2+ p:13+ p:7+ p:31+ p:4+)",
    "main(h1:2+ p:8+ p:6+ p:3+ p:9+ p:2+ p:14+ p:9+ p:16+ p:12+ p:31+ p:44+ p:2+ p:18+ p:15+ p:12+ p:7+ p:11+ p:10+ p:15+ p:16+ p:16+ p:8+ p:6+ p:15+ p:20+ p:12+ p:6+ p:7+ p:8+ p:31+)",
    "article(h1:6+ p:9+ p:11+ p:6+ p:8+ p:1+ p:18+ p:2+ p:8+ p:31+ p:4+ p:12+ p:20+ p:18+ p:5+ p:1+ p:11+ p:9+ p:44+ p:4+ p:8+ p:18+ p:18+ p:16+ p:16+ p:44+ p:12+ p:9+ p:15+ p:6+ p:15+)",
    # furniture of middling length after paragraphs of middling length
    "article(p:60+ p:36+) footer:16-", "h1:5+ p:80+ p:37+ div.sidebar:15-", "h1:4+ div:90+ div:38+ footer:18-", "main(h1:6+ p:33+ p:28+) footer(p:21- p:13-)", "article(h1:3+ p:20+ p:35+) div.cookie:24- footer:9-", "h2:5+ p:48+ p:39+ div.comments(p:14- p:22-) footer:11-",
    # what asks something of the reader inside an article
    "main(p:30+ div.login:8-)", "main(h1:4+ p:45+ p:20+ div.login(p:9- p:4-))", "article(p:60+ div.login:6- p:35+)", "article(h1:6+ div.notice:12- p:70+ p:22+ div.subscribe(p:7- p:3-))", "main(p:18+ p:25+ div.signup:9-)", "article(p:12+ div.related(p:4/4- p:5/5-))",
    # names that only may mean furniture
    "div.share-of-voice(h1:5+ p:85+ p:9+ p:70+) div.share(p:4- p:2/2-)",
    "div.login(p:9- p:12-) h1:6+ p:95+ p:130+ div.promo(p:11- p:16-) p:60+ p:5+ p:40+ div.related(h3:2- p:5/5- p:8-)",
    "div.header(p:4- p:2/2-) div.notice:18- h1:4+ p:66+ p:45+ div.widget(p:3- p:12-) div.disclaimer:24-",
    "div.banner:13- div.menu(li:1/1- li:2-) p:52+ div.press-notice(p:95+ p:64+ p:50+) p:177+ p:150+ div.subscribe:15-",
    "article(h1:7+ p:210+ div.widget-theory(p:80+ p:140+) p:160+ p:12+ div.promo:20- p:48+)", "p:300+ p:210+ div.social-history(p:120+ p:75+) p:90+ div.promotion(p:16- p:9-)",
    # furniture that is long
    "div.sidebar(p:90- p:130-) h1:9+ p:140+ p:33+ div.comments(p:60- p:110- p:7-)",
    "aside(p:75- p:45/3-) p:88+ p:61+ div.newsletter(p:36- p:4-) p:9+ p:50+ footer(p:70/5- p:44-)",
)
_ITEM = re.compile(r"(\w+)([.#][\w-]+)?(?:\(|:(\d+)(?:/(\d+))?([+-]))|(\))")


def labelled(page: str) -> tuple[str, list[int]]:
    """The HTML of a labelled page, and its blocks' labels."""
    html, labels, open_ = [], [], []
    for tag, name, words, linked, label, end in _ITEM.findall(page):
        if end:
            html.append(f"</{open_.pop()}>")
            continue
        html.append(f'<{tag} {"class" if name[0] == "." else "id"}="{name[1:]}">' if name else f"<{tag}>")
        if not words:
            open_.append(tag)
            continue
        n = int(linked or 0)
        html.append(f'<a href="x">{"w " * n}</a>{"w " * (int(words) - n)}</{tag}>')
        labels.append(int(label == "+"))
    return "".join(html), labels


def table() -> list[tuple]:
    """Rows of FEATURES and label."""
    rows = []
    for page in PAGES:
        html, labels = labelled(page)
        rows += [(*x, y) for x, y in zip(features_of(blocks_of(html)), labels, strict=True)]
    return rows


#: Rows that a branch must have: the tree takes no odd row of the table for a rule.
LEAST = 4


def grow(rows: list[tuple], depth: int = 12) -> tuple | float:
    """A tree of (feature, bound, below or equal, above) with shares of content at the leaves."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0, 1):
        return share
    gini = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p)
    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[k] <= (a + b) / 2], [r for r in rows if r[k] > (a + b) / 2]
            if min(len(low), len(high)) < LEAST:
                continue
            if best is None or gini(low) + gini(high) < best[0] - 1e-9:
                best = gini(low) + gini(high), k, (a + b) / 2, low, high
    return share if best is None else (best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1))


TREE = grow(table())


def splits(tree: tuple | float = TREE) -> list[tuple[str, float]]:
    """The tree's splits, from the root on."""
    return [] if not isinstance(tree, tuple) else [(FEATURES[tree[0]], tree[1]), *splits(tree[2]), *splits(tree[3])]


def is_content(features: tuple, tree: tuple | float = TREE) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def text_of(page: str | None) -> str:
    """The page's main text."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, x in zip(blocks, features_of(blocks), strict=True) if is_content(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), each, "page_id long, url string, text string, n_chars long")
