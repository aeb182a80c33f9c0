"""Main-text extraction by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path (tags with their classes). For each path, text length and punctuation per
node are aggregated, both are smoothed over neighbouring paths in page order with a Gaussian, and fused by their product; tags, roles and
names that speak of menus, notices, adverts, forms, comments and so on lower the value of what they hold. Nodes whose value reaches a share
of the values' spread are content. What else is text of the article follows from where the content nodes are:

* the root is the least element that holds them all, or the <article> or <main> around it;
* inside the root, unmarked nodes between content nodes stay, so do unmarked ones at its ends unless their path is mostly link text;
* where only the page's body holds them all, nodes between content nodes stay if they share a container with one of these;
* headings that stand right before the root, or before an element around it, stay.

A name, a role or <form> marks nothing that holds most of the content weight, <main> or the page's only <article>: that is a wrapper of the
page. A <header> marks nothing inside an article, a <button> nothing inside a paragraph.

Blocks: block elements part texts, inline elements do not, <br> is white space. Character references are decoded, white space (any
Unicode) becomes one space, blocks are trimmed, empty ones go, the rest is joined by one newline.

Defined cases: null, empty and tag-less pages give the empty string or their plain text; unclosed and stray tags are mended as
browsers do for p, li, dt, dd, tr, td; comments and CDATA are markup; repeated pages give the same text; null ids stay.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("html body main article section div td tr tbody table center form".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"option", "select", "tbody", "td", "th", "thead", "tfoot", "tr", "html", "head", "body"}
#: What an opening tag ends, up to the given ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Parts of a page that are not its article.
APART = frozenset("nav header footer aside form dialog button select menu search head svg object audio video canvas datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
WORDS = frozenset("ad ads adv nav navbar side aside alert pager legal login tags tool tools popup modal dialog overlay copyright form replies reply".split())
STARTS = ("advert", "sponsor", "promo", "banner", "sidebar", "menu", "header", "footer", "masthead", "navig", "breadcrumb", "pagina", "comment", "disqus", "cookie", "consent", "gdpr", "notice", "notif", "newsletter", "subscri", "signup", "share", "sharing", "social", "related", "recommend", "widget", "disclaimer", "outbrain", "taboola", "toolbar", "skip", "hidden")
#: What may stand beside such a word in one name; any other word makes it a name of something else, such as share-price.
BESIDE = frozenset("area bar block body bottom box btn button buttons banner center column container content count div feed footer form group header icon icons id inner item items js left line link links list main message msg module nav outer page pane panel policy post posts primary right row section site slot text title top unit wrap wrapper holder secondary thread widget bottombar topbar menu".split())
_PUNCT = frozenset(".,;:!?\"'()…—–،。，、！？：；«»„“”")
SIGMA, SPREAD, LINKS = 1.0, 0.8, 0.6
#: How an element is marked: not, by what may also name a wrapper of the page, or for sure.
CLEAR, NAMED, SURE = 0, 1, 2
#: What a mark leaves of a value.
LOWERED = (1.0, 0.02, 0.0)
_PROSE = frozenset("p li td dd blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper stand beside each other, as in browsers; their text stays.
DEEPEST = 512


class _Node:
    """An element. path: a number for its root-to-leaf tag path; apart: how it is marked as not the article's; shut: the strongest mark on it or an element that holds it."""

    __slots__ = ("tag", "up", "path", "apart", "shut", "link", "held", "kids", "block", "depth", "told")

    def __init__(self, tag: str, up: _Node | None, path: int, apart: int):
        self.tag, self.up, self.path = tag, up, path
        # an element of the article's own: its header, a button in a sentence
        self.told = bool(up and (up.told or up.tag in ("article", "section", "main")))
        own = tag in ("html", "body", "main", "article") or (tag == "header" and self.told) or (tag == "button" and up.block.tag in _PROSE)
        self.apart = CLEAR if own else apart
        self.shut = max(self.apart, up.shut) if up else self.apart
        self.link = tag == "a" or bool(up and up.link)
        self.depth = up.depth + 1 if up else 0
        self.held, self.kids = 0, []
        self.block = self if tag in BLOCK or up is None else up.block


def _marked(tag: str, attrs: dict[str, str]) -> int:
    if (tag in APART and tag != "form") or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return SURE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return SURE
    if tag == "form" or attrs.get("role", "").lower() in ROLES:
        return NAMED
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        telling = [w in WORDS or w.startswith(STARTS) for w in words]
        if any(telling) and all(x or w in BESIDE or w.isdigit() for x, w in zip(telling, words, strict=True)):
            return NAMED
    return CLEAR


def _clear_wrappers(nodes: list[_Node], own: list[tuple[_Node, str]], content: set[int]) -> None:
    """Unmarks what is only marked by name and holds <main> or the page's only <article>, or on pages without these most of the content weight."""
    for n, t in own:
        if n.shut < SURE and n.path in content:
            n.held += len(t.strip())
    for n in reversed(nodes[1:]):
        n.up.held += n.held
    articles = [n for n in nodes if n.tag == "article"]
    around = set()
    for x in [n for n in nodes if n.tag == "main"] + articles * (len(articles) == 1):
        while x is not None and x not in around:
            around.add(x)
            x = x.up
    for n in nodes[1:]:
        if n.apart == NAMED and (n in around or (not around and 2 * n.held > nodes[0].held)):
            n.apart = CLEAR
        n.shut = max(n.apart, n.up.shut)


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The elements, holders before what they hold, the root first; (element, decoded text) of the text nodes in page order."""
    root = at = _Node("", None, 0, False)
    nodes = [root]
    paths: dict[tuple[int, str], int] = {}
    texts: list[tuple[_Node, str]] = []
    memo: dict[tuple[str, str], tuple[str, int]] = {}
    end = len(page)
    pos = 0
    while pos < end and (m := _TOKEN.match(page, pos)):
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                texts.append((at, html.unescape(m[0])))
            continue
        tag, closing = name.lower(), m[1] if m[2] else m[4]
        if closing:
            x = at
            while x.up and x.tag != tag:
                x = x.up
            if x.up:
                at = x.up
            elif tag == "br":
                texts.append((at, " "))
            continue
        if tag in CLOSES_P:
            x = at
            while x.up and x.tag not in ("p", "button", "td", "th", "table", "article", "section", "div"):
                x = x.up
            if x.tag == "p":
                at = x.up
        if tag in ENDS:
            over, until = ENDS[tag]
            x = at
            while x.up and x.tag not in over and x.tag not in until:
                x = x.up
            if x.tag in over:
                at = x.up
        if tag == "br":
            texts.append((at, " "))
        if tag in VOID:
            continue
        raw = m[3] if m[2] else m[6]
        key = (tag, raw)
        if key not in memo:
            attrs = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(raw)} if raw.strip(" /") else {}
            memo[key] = (tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())), _marked(tag, attrs))
        label, apart = memo[key]
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
            pos = end if stop is None else (page.find(">", stop.start()) + 1 or end)
            continue
        if raw.endswith("/") and tag not in BLOCK:
            continue
        if at.depth >= DEEPEST:
            at = at.up
        node = _Node(tag, at, paths.setdefault((at.path, label), len(paths) + 1), apart)
        at.kids.append(node)
        nodes.append(node)
        at = node
    return nodes, texts


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes, texts = _parse(page)
    root = nodes[0]
    own = [(n, t) for n, t in texts if t.strip()]
    if not own:
        return ""
    paths: dict[int, list[float]] = {}  # nodes, length, punctuation, length of links
    for n, t in own:
        p = paths.setdefault(n.path, [0, 0, 0, 0])
        size = len(t.strip())
        p[0] += 1
        p[1] += size
        p[2] += sum(map(t.count, _PUNCT))
        p[3] += size if n.link else 0
    rows = list(paths.values())
    reach = range(-3, 4)
    kernel = {d: math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in reach}

    def smooth(x: list[float]) -> list[float]:
        return [sum(kernel[d] * x[i + d] for d in reach if 0 <= i + d < len(x)) / sum(kernel[d] for d in reach if 0 <= i + d < len(x)) for i in range(len(x))]

    length, marks = [r[1] / r[0] for r in rows], [r[2] / r[0] for r in rows]
    fused = [math.sqrt(a * s * (1 + b) * (1 + u)) * (1 - r[3] / r[1]) for a, s, b, u, r in zip(length, smooth(length), marks, smooth(marks), rows, strict=True)]
    value = dict(zip(paths, fused, strict=True))
    bar = _bar(fused)
    _clear_wrappers(nodes, own, {p for p, f in value.items() if f >= bar and f > 0})
    left: dict[int, float] = {}
    for n, _ in own:
        left[n.path] = max(left.get(n.path, 0.0), value[n.path] * LOWERED[n.shut])
    bar = _bar(list(left.values()))
    chosen = [(i, n) for i, (n, t) in enumerate(texts) if t.strip() and (v := value[n.path] * LOWERED[n.shut]) >= bar and v > 0]
    if not chosen:  # nothing but marked parts
        return ""
    kept = _kept(texts, chosen, {p for p, r in paths.items() if r[3] > LINKS * r[1]})
    blocks: list[str] = []
    run: list[str] = []
    last: _Node | None = None
    for i, (n, t) in enumerate(texts):
        if i not in kept:
            continue
        if n.block is not last and run:
            blocks.append(" ".join("".join(run).split()))
            run = []
        last = n.block
        run.append(t)
    blocks.append(" ".join("".join(run).split()))
    return "\n".join(b for b in blocks if b)


def _bar(values: list[float]) -> float:
    """The least value of content: a share of the values' spread."""
    mean = sum(values) / len(values)
    return SPREAD * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _meet(a: _Node, b: _Node) -> _Node:
    """The least element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


def _clear_below(n: _Node, top: _Node, plain: bool = False) -> bool:
    """No mark, and (plain) no container, stands between an element and one that holds it."""
    while n is not top:
        if n is None or n.apart or (plain and n.tag in CONTAINER):
            return False
        n = n.up
    return True


def _kept(texts: list[tuple[_Node, str]], chosen: list[tuple[int, _Node]], linked: set[int]) -> set[int]:
    """The texts that belong to the article, by number, from those that are content."""
    root = chosen[0][1]
    for _, n in chosen[1:]:
        root = _meet(root, n)
    x = root
    while x is not None and x.tag not in ("article", "main"):
        x = x.up
    if x is None:
        x = root.block
        while x.up and x.tag not in CONTAINER:
            x = x.up
    root = x
    whole = root.tag in ("", "html", "body")
    kept = {i for i, _ in chosen}
    ends = iter([*chosen, (len(texts), None)])
    before: _Node | None = None
    at, after = next(ends)
    for i, (n, _) in enumerate(texts):
        if i == at:
            before, (at, after) = n, next(ends)
            continue
        between = before is not None and after is not None
        if whole:
            if between and _within(n, _meet(before, after)):
                top = max(_meet(n, before), _meet(n, after), key=lambda x: x.depth)
                if _clear_below(n, top, top.tag in ("", "html", "body")):
                    kept.add(i)
        elif _within(n, root) and (between or n.path not in linked) and _clear_below(n, root):
            kept.add(i)
    return kept | _headings(texts, root, chosen[0][1])


def _within(n: _Node, top: _Node) -> bool:
    while n.depth > top.depth:
        n = n.up
    return n is top


def _headings(texts: list[tuple[_Node, str]], root: _Node, first: _Node) -> set[int]:
    """Texts of unmarked headings right before the root, or before elements around it or, if the root is the page, before what holds the first content."""
    x = root
    if root.tag in ("", "html", "body"):
        x = first
        while x.up is not None and x.up is not root:
            x = x.up
    found: set[_Node] = set()
    while x.up is not None:
        beside = x.up.kids[: x.up.kids.index(x)]
        while beside and beside[-1].tag in (*HEADING, "hgroup") and not beside[-1].shut:
            found.add(beside.pop())
        if beside:
            break
        x = x.up

    def inside(n: _Node | None) -> bool:
        while n is not None:
            if n in found:
                return True
            n = n.up
        return False

    return {i for i, (n, _) in enumerate(texts) if inside(n)} if found else set()


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, html -> keep columns, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([extract(h) for h in b.columns[-1].to_pylist()], pa.string())], [*keep, "text"])

    ready(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kinds}, text string")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
