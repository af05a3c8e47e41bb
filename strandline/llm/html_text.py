"""HTML extraction with site template removal: element subtrees are hashed, counted per host in Spark, and recurring ones deleted."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Store

#: A subtree is template if it is on so many pages of its host with unlike main parts: however many pages the host has.
MIN_PAGES = 10
#: Template subtrees that are sent to every worker, 16 bytes each; more are joined to their pages by a shuffle.
BROADCAST_ROWS = 200_000
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt li legend optgroup option summary tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_P_SCOPES = frozenset("table td th article section div body main aside nav footer header button object".split())
_P_OTHERS = frozenset("table td th button object".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: What is never main text.
DROP_TAGS = frozenset("nav aside footer form search menu button select dialog head object canvas audio video map datalist input".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: What a class or id calls menus, notices and the like. A name counts if each of its parts, such as `cookie` and `notice`, is one of these or NEUTRAL, and one at least is one of these.
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond related recommended recommendations share sharing social toolbar pagination pager widget widgets skip".split()
)
NEUTRAL = frozenset("area bar block bottom box button buttons container form header holder icon icons inner items left link links list main outer page panel placeholder posts right row section site slot text thread to top unit wrap wrapper".split())
MAIN_NAMES = frozenset("content article post entry story main maincontent".split())
COMMENTS = frozenset("comment comments replies disqus respond".split())
#: Blocks of text: inside an article they are never template, and what they are called doesn't count.
TEXTS = frozenset("p li blockquote pre dd dt td th tr tbody thead tfoot caption figcaption summary h1 h2 h3 h4 h5 h6 article main body html".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: Node | None
    children: list = field(default_factory=list)
    hash: int = 0
    text: bool = False


def parse(page: str) -> Node:
    """A tree of elements and texts; open elements end where HTML says so, or with the page. Nesting of any depth is a stack."""
    root = Node("html", "", None)
    stack, opened = [root], Counter()
    at = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def close_implied(tags, scopes) -> None:
        """Closes open elements of tags, up to the innermost of scopes."""
        if not any(opened[t] for t in tags):
            return
        lowest = None
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in tags:
                lowest = depth
            elif tag in scopes:
                break
        if lowest:
            close(lowest)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                if depth:
                    close(depth)
            continue
        if tag in CLOSES_P:
            close_implied(("p",), _P_SCOPES - {tag} if tag == "p" else _P_OTHERS)
        if tag in SIBLINGS:
            close_implied(SIBLINGS[tag], SCOPES[tag])
        if tag in ("html", "body") and opened[tag]:
            continue
        node = Node(tag, m[3], stack[-1])
        stack[-1].children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            stack.append(node)
            opened[tag] += 1
    if at < len(page) and (rest := page[at:]) and not re.match(r"</?[a-zA-Z]", rest):
        stack[-1].children.append(rest)
    return root


def _names(attrs: str) -> tuple[set[str], set[str], bool]:
    """Whole names in class and id, roles, and whether the element is hidden."""
    if not attrs.strip("/ "):
        return set(), set(), False
    names, roles, hidden = set(), set(), False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role":
            roles.update(value.split())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, roles, hidden


def _called(names: set[str], words: frozenset[str]) -> bool:
    """Whether a name has a part in words and no part that speaks of something else: `cookie-notice`, `ad-300x250`, but not `share-price`."""
    for name in names:
        parts = _PART.findall(name)
        if any(p in words for p in parts) and all(p in words or p in NEUTRAL or p in DROP_NAMES or any(c.isdigit() for c in p) for p in parts):
            return True
    return False


def _unwanted(node: Node, inside: bool) -> bool:
    """Whether an element is no main text by what it is or is called. inside: of an article or the like."""
    if node.tag in RAW or node.tag in DROP_TAGS:
        return True
    if node.tag in ("body", "html", "main"):
        return False
    names, roles, hidden = _names(node.attrs)
    if hidden or roles & DROP_ROLES:
        return True
    if node.tag == "article":
        return _called(names, COMMENTS)
    if inside and node.tag in TEXTS:
        return False
    if node.tag == "header" or node.tag not in HEADINGS and _called(names, frozenset(("header",))):
        return not inside
    return _called(names, DROP_NAMES)


def main_parts(root: Node, gone: frozenset[int] | set[int] = frozenset()) -> list[Node]:
    """The articles outside of unwanted elements and of those in gone; else the main element; else what is called content; else all."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo: list[tuple[Node, str]] = [(root, "")]
    while todo:
        node, within = todo.pop()
        if node is not root and (id(node) in gone or _unwanted(node, node.tag == "header")):
            continue
        names, roles, _ = _names(node.attrs)
        kind = "article" if node.tag == "article" else "main" if node.tag == "main" or "main" in roles else "named" if node.tag in ("div", "section") and _named_main(names) else ""
        if kind and kind not in within:  # of parts of a kind, the outermost
            found[kind].append(node)
        if kind != "article":
            todo += [(c, f"{within} {kind}" if kind else within) for c in reversed(node.children) if isinstance(c, Node)]
    return found["article"] or found["main"] or found["named"] or [root]


def _named_main(names: set[str]) -> bool:
    return any(p in MAIN_NAMES for n in names for p in _PART.findall(n))


def hash_subtrees(root: Node) -> None:
    """Gives each element a 64-bit hash of its tags and texts, with white space evened out and without attributes, scripts and styles; and whether it has text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.tag not in RAW]
    for node in reversed(order):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for c in node.children:
            if isinstance(c, Node):
                if c.tag not in RAW:
                    h.update(b"<%d" % c.hash)
                    node.text |= c.text
            elif text := " ".join(c.split()):
                h.update(b"=" + text.encode("utf-8", "surrogatepass"))
                node.text = True
        node.hash = int.from_bytes(h.digest(), "little", signed=True)


def subtrees(root: Node, parts: list[Node]) -> list[Node]:
    """Elements of the whole page, hashed, that may be template: blocks with text. In an article or main part its blocks of text are its own, however common."""
    hash_subtrees(root)
    own = {id(p) for p in parts if p.tag != "html"}
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.tag in RAW:
            continue
        if node.text and node.tag in BLOCK and node.tag not in ("html", "body", "main", "article", "head") and id(node) not in own and not (inside and node.tag in TEXTS):
            out.append(node)
        inside = inside or id(node) in own
        todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    return out


def text_of(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text, without subtrees whose hash is in template."""
    root = parse(page)
    parts = main_parts(root)
    gone: set[int] = set()
    if template:
        gone = {id(n) for n in subtrees(root, parts) if n.hash in template}
        parts = main_parts(root, gone)
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", html.unescape("".join(inline))).strip():
            blocks.append(text)
        inline.clear()

    for part in parts:
        inside = part.tag != "html"
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                inline.append(x)
            elif x is part or not (_unwanted(x, inside) or id(x) in gone):
                if x.tag == "header" and x is not part:
                    todo += [None, *reversed(_headings(x)), None]
                elif x.tag == "br":
                    inline.append(" ")
                elif x.tag in BLOCK:
                    todo += [None, *reversed(x.children), None]
                else:
                    todo += reversed(x.children)
        flush()
    return "\n".join(blocks)


def _headings(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            out.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _own(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias("_html")).withColumns({"_host": _host(F.col(url_col)), "_page": F.xxhash64("_html")})


def page_subtrees(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, main, h): each subtree of each page that may be template, with hashes of the page and of its main part."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = parse(source)
                parts = main_parts(root)
                found = {n.hash for n in subtrees(root, parts)}
                for column, value in zip(out, (host, page, parts[0].hash), strict=False):
                    column += [value] * len(found)
                out[3] += found
            yield pa.record_batch([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["host", "page", "main", "h"])

    ship(pages.sparkSession)
    own = _own(pages, id_col, url_col, html_col).select("_host", "_page", "_html")
    return own.mapInArrow(hashes, "host string, page bigint, main bigint, h bigint")


def templates(found: DataFrame, min_pages: int) -> DataFrame:
    """(host, h): subtrees on at least min_pages pages of a host with unlike main parts. Counts are pre-aggregated, so a hot host stays split."""
    return found.groupBy("host", "h", "main").agg(F.count("*").alias("_")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "h")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    One scan hashes the element subtrees of the whole page, menus and notices as well as what is in the article. Spark
    counts on how many pages of a host, with unlike main parts, each is: copies of a page count once. Those on min_pages are
    template. A second scan deletes them and gives the text of what is left of the article, or where there is none of the
    main or content element, else of the page; again without what elements, roles and whole names call menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments. Paragraphs, headings, items and cells in an article are
    its own: they are never template, whatever they are called and however common. Templates are broadcast up to
    broadcast_rows; beyond, each page gets its own by a join on (host, page).

    A null page is empty, a null url a host of its own; repeated rows stay, and get the same text. Extra columns are
    ignored. Pages are parsed whole, whatever their length and depth.
    """
    store = Store(pages.sparkSession)
    found = store.put(page_subtrees(pages, id_col, url_col, html_col), "subtrees")
    template = store.put(templates(found, min_pages), "templates")
    own = _own(pages, id_col, url_col, html_col)
    schema = f"{pages.select(id_col, url_col).schema.simpleString()[7:-1]}, text string, n_chars bigint"

    def texts(template_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [text_of(p, frozenset(template_of(t) or ())) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

        return run

    if template.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for host, h in template.collect():  # broadcast_rows at most
            by_host.setdefault(host, set()).add(h)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        return own.select(id_col, url_col, "_html", "_host").mapInArrow(texts(lambda host: sent.value.get(host)), schema)
    mark = template.select(F.col("host").alias("_th"), F.col("h").alias("_t"))
    hits = found.join(mark, (F.col("host") == F.col("_th")) & (F.col("h") == F.col("_t"))).groupBy(F.col("host").alias("_hh"), F.col("page").alias("_pp")).agg(F.collect_set("h").alias("template"))
    rows = own.join(hits, (F.col("_host") == F.col("_hh")) & (F.col("_page") == F.col("_pp")), "left").select(id_col, url_col, "_html", "template")
    return rows.mapInArrow(texts(lambda t: t), schema)
