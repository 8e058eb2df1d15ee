"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.textarrays import slices

# Element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold the article.
CHROME = set("head script style noscript template iframe svg math button select option textarea input object canvas audio video title xmp noembed noframes".split())
#: Elements that count as marked surroundings.
ASIDE = set("nav footer aside form dialog menu".split())
#: What the density below marked surroundings is worth when the article is looked for.
MARKED_WEIGHT = 0.1
#: Words of a class, id or role that mark what surrounds an article or follows it.
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond discussion widget widgets pagination pager copyright search searchbox complementary contentinfo tagcloud".split()
)
#: Elements of running text; only adverts are marked among them.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th figure figcaption dl dt dd em strong b i q cite code".split())
AD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
CONTAINERS = set("div section center table tbody tr td ul ol dl".split())
#: Elements whose start ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block starts close an open paragraph.
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements an implied end does not reach beyond.
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote"}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?|[^>]*)>""", re.S)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNDISPLAYED = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    """An element: its parts in order (strings and nodes), and what the densities need."""

    __slots__ = ("name", "parts", "parent", "chrome", "noise", "main", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, chrome: bool = False, noise: bool = False, main: bool = False):
        self.name, self.parent, self.chrome, self.noise, self.main, self.parts = name, parent, chrome, noise, main, []


def _hidden(attributes: str) -> bool:
    """Whether an attribute, not a word inside the value of another, hides the element."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute == "hidden" or attribute == "aria-hidden" and value.strip().lower() == "true" or attribute == "style" and _UNDISPLAYED.search(value):
            return True
    return False


def _marked(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(never text, marked as surroundings, marked as article) from an element's name and marks."""
    words: set[str] = set()
    for m in _MARKS.finditer(attributes):
        words.update(_SPLIT.split((m[2] or m[3] or m[4] or "").lower()))
    main = name in ("article", "main") or bool(words & MAIN_WORDS)
    noise = name in ASIDE or bool(words & (AD_WORDS if name in TEXTUAL else CHROME_WORDS) and name not in ("article", "main", "body", "html"))
    return name in CHROME or _hidden(attributes), noise, main


def parse(page: str) -> Node:
    """A tree of the page. Unclosed elements end with what encloses them; stray end tags are skipped."""
    root = Node("html", None)
    at, here = 0, root
    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            here.parts.append(text)
        if m is None:
            return root
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.name != name:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        closing = CLOSES.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if closing:
            node = here
            while node is not root and node.name not in closing and node.name not in SCOPE:
                node = node.parent
            if node.name in closing and node is not root:
                here = node.parent
        node = Node(name, here, *_marked(name, m[3] or ""))
        here.parts.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (m[3] or "").endswith("/"):
            here = node


def _measure(root: Node) -> list[Node]:
    """Fill in characters and tags of every node outside the surroundings; children come before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.parts if isinstance(x, Node) and not x.chrome)
    order.reverse()
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.chrome:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, 1
    body = root
    for node in order:
        # characters per tag, weighed down by the share of characters and tags in links
        tags, links, rest = max(1, node.tags), max(1, node.link_chars), max(1, node.chars - node.link_chars)
        base = math.log(node.chars / rest * node.link_chars + body.link_chars / max(1, body.chars) * node.chars + math.e)
        inner = node.chars / links * tags / max(1, node.link_tags)
        node.density = node.chars / tags * math.log(max(inner, 1.0)) / max(math.log(max(base, 1.0 + 1e-9)), 1e-9) if node.chars else 0.0
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.chrome)
    return order


def _way(node: Node) -> list[Node]:
    """The node and what it lies in, up to the root."""
    way = [node]
    while way[-1].parent is not None:
        way.append(way[-1].parent)
    return way


def _cut_surroundings(root: Node) -> None:
    """Leave out marked surroundings, but nothing that holds the article.

    Marks of what holds the largest article element are void, or, on a page without one, of what holds half
    of the text outside links. Below the others densities are weighed down; the marks of what holds the node
    with the greatest weighed sum are void too, unless its text is mostly links.
    """
    order = _measure(root)
    if not any(n.noise for n in order):
        return
    named = [n for n in order if n.name in ("article", "main") and n.chars and 2 * n.link_chars <= n.chars]
    # a short one inside surroundings is a teaser
    named = [n for n in named if 4 * n.chars >= root.chars or not any(x.noise for x in _way(n))]
    if named:
        wide = _way(max(named, key=lambda n: n.chars))
    else:
        wide = [n for n in order if n.noise and 2 * (n.chars - n.link_chars) >= max(1, root.chars - root.link_chars)]
    for n in wide:
        n.noise = False
    weight: dict[Node, float] = {}
    for n in reversed(order):
        weight[n] = (weight[n.parent] if n.parent is not None else 1.0) * (MARKED_WEIGHT if n.noise else 1.0)
    best = max(order, key=lambda n: (sum(x.density * weight[x] for x in n.parts if isinstance(x, Node) and not x.chrome), n.density * weight[n]))
    if 2 * best.link_chars <= best.chars:
        for n in _way(best):
            n.noise = False
    for n in order:
        n.chrome = n.chrome or n.noise


def select(root: Node) -> Node:
    """The root of the article; what does not belong to it below is marked as surroundings.

    The node with the greatest sum of child densities is taken, or the densest if no node has children
    that count. An element above it that is marked as the article wins, the outermost of them, or else one
    anywhere that holds half of the text, or else the part of the body that leads to the node. On each
    level of the way there containers are left out that are thinner than the thinnest node between the
    chosen one and the body, or whose text is links by more than half.
    """
    _cut_surroundings(root)
    order = _measure(root)
    rank = lambda n: (n.total, n.density)
    way = _way(max(order, key=rank))
    inner = [n for n in way if n.name not in ("body", "html")]
    # children come before parents, so the last is the outermost
    marked = [n for n in inner if n.main]
    if not marked:
        marked = [n for n in order if n.main and 2 * n.chars >= root.chars]
        if marked:
            below = [marked[-1]]
            for n in below:
                below.extend(x for x in n.parts if isinstance(x, Node) and not x.chrome)
            way = _way(max(below, key=rank))
            inner = [n for n in way if n.name not in ("body", "html")]
    if not inner:
        return way[0]
    top = marked[-1] if marked else inner[-1]
    threshold = min(n.density for n in way)
    held = set(way)
    levels = inner[: inner.index(top) + 1] if top in inner else []
    for level in levels if marked else levels[1:]:
        for x in level.parts:
            if isinstance(x, Node) and x.name in CONTAINERS and not x.chrome and x not in held:
                # a table is thin by its cells, so only links tell that it is none of the article's
                x.chrome = x.density < threshold and x.name not in TEXTUAL or 2 * x.link_chars > x.chars
    return top


def _blocks(node: Node, out: list[str], article: bool) -> None:
    """Texts of the blocks below ``node``, white space inside a block made one space."""
    stack = [iter(node.parts)]
    run: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    names = [node]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if names.pop().name not in INLINE:
                flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br" or x.name == "hr":
            run.append(" ") if x.name == "br" else flush()
        elif x.chrome or (x.name == "header" and not article):
            if x.name not in INLINE:
                flush()
        else:
            if x.name not in INLINE:
                flush()
            stack.append(iter(x.parts))
            names.append(x)


def main_text(page: str | None) -> str:
    """The article of a page as one line of text."""
    if not page:
        return ""
    out: list[str] = []
    node = select(parse(page))
    _blocks(node, out, node.main)
    return " ".join(out)


def extract_main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``text string`` and ``n_chars bigint`` instead of ``source``.

    General operator: the project keeps no web pages. NULL and empty pages, and pages without an
    article, give an empty text. Character references are decoded after markup is cut, so a decoded sign
    is never taken for a tag. Repeated rows are extracted one by one; columns named text or n_chars are
    replaced.

    A page is parsed leniently: unclosed and crossing elements, comments and quoted signs in attributes
    are understood, and depth costs no stack. What names, classes, ids or roles mark as surroundings
    does not count for any density unless it holds the article. No shuffle; a task holds the pages of a few megabytes.
    """
    columns = [c for c in pages.columns if c not in (source, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    rows = pages.select(*columns, F.col(source).cast("string").alias("_html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes)
    return rows.mapInArrow(run, f"{schema + ', ' if columns else ''}text string, n_chars bigint")
