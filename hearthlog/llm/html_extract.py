"""Main text of web pages by tree scoring.

The page becomes a tree (void and unclosed elements repaired as they come). Elements that never hold
the article (scripts, menus, headers, footers, forms, adverts, notices, comments, hidden parts) are cut
off by name, role, class or id (a class counts as a whole, or by its first or last word where the others only say what kind of
part it is; comments and the like are also cut inside the article). Every text block then passes points, one plus its commas plus one for
each 100 characters, times one minus its link density, to its ancestors: all to the parent, half to
the next, a third to the one above. The element with the most points, or the article or main around it, or its
parent if that has parts of text only, is the container; siblings with a fifth of its points, and headings
before it, are kept with it, and so are other articles beside an article. All their blocks are returned in page order, but for
lists that are nearly all links; such lists stay inside an article or main that has other text (its references).

Defined cases: null or empty html, and pages without text, give an empty text; broken markup never
raises, and an unended tag at the end of a page is dropped; pages of any length and nesting of any depth take time in
proportion to their length, without recursion; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
_CUT_TAGS = frozenset("head nav header footer aside form button select option dialog menu fieldset label audio video canvas figcaption".split()) - {"figcaption"}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments commentlist reply replies respond disqus discussion widget toolbar pagination pager skip".split()
)
#: Words that say what kind of part an element is, beside one of the names above.
_KINDS = frozenset(
    "area bar block body bottom box button buttons card cards column container content desktop first footer form global group header holder inner item items last layout left link links "
    "list main mobile module nav outer page panel post posts primary right section secondary site slot static sticky text thread top unit widget widgets wrap wrapper articles stories".split()
)
_SECTIONS = frozenset("body article main section div td table".split())
#: Start tags that end an open element of the given kinds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = frozenset("table ul ol dl td th article section div body html blockquote main".split())
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_COMMENT_END = re.compile(r"--!?>")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "text", "linked", "commas", "cut")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.text, self.linked, self.commas, self.cut = 0.0, 0, 0, 0, False


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attrs)} if node.attrs else {}


def _boilerplate(node: Node) -> bool:
    if node.tag in _CUT_TAGS:
        return True
    if not node.attrs or node.tag in ("body", "html"):
        return False
    attrs = _attributes(node)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in _CUT_ROLES:
        return True
    if node.tag in ("article", "main") or node.tag in _INLINE and node.tag != "span":
        return False
    return any(_cut_name(_NAME.findall(_HUMP.sub(r"\1 \2", name).lower())) for a in ("class", "id") for name in attrs.get(a, "").split())


def _cut_name(words: list[str]) -> bool:
    """Whether the words of one class or id are such a name: one word, or the first or last with only kinds of parts and such names beside it."""
    return bool(words) and (words[0] in _CUT_NAMES or words[-1] in _CUT_NAMES) and all(w in _CUT_NAMES or w in _KINDS for w in words)


class _Open:
    """The open elements, with the depths of each tag and of the scopes, so that no end tag has to look for its start."""

    def __init__(self):
        self.root = Node("html")
        self._stack, self._at, self._scopes = [self.root], {}, [0]

    @property
    def node(self) -> Node:
        return self._stack[-1]

    def depth(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def scope(self) -> int:
        return self._scopes[-1]

    def push(self, node: Node) -> None:
        self._at.setdefault(node.tag, []).append(len(self._stack))
        if node.tag in _SCOPES:
            self._scopes.append(len(self._stack))
        self._stack.append(node)

    def close(self, depth: int) -> None:
        """Ends the element at the depth and all in it."""
        while len(self._stack) > depth:
            self._at[self._stack.pop().tag].pop()
            if self._scopes[-1] == len(self._stack):
                self._scopes.pop()


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: at the first ``>`` outside quoted values, or else at the first one; -1 for none."""
    m = _REST.match(html, at)
    return m.end() - 1 if m else html.find(">", at)


def _comment_end(html: str, at: int) -> int:
    """Where text goes on after a comment whose text starts at ``at``; ``<!-->`` and ``<!--->`` are whole comments."""
    for whole in (">", "->"):
        if html.startswith(whole, at):
            return at + len(whole)
    m = _COMMENT_END.search(html, at)
    return m.end() if m else len(html)


def _raw_end(html: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
    return m.end() if m else -1


def parse(html: str) -> Node:
    """The tree of a page, without what raw-text elements hold. Time is in proportion to the length."""
    open_, at, size, unended = _Open(), 0, len(html), set()
    while at < size:
        start = html.find("<", at)
        m = _START.match(html, start) if start >= 0 else None
        text = html[at : (start if m else start + 1 if start >= 0 else size)]
        if text:
            open_.node.children.append(unescape(text) if "&" in text else text)
        if not m:
            at = start + 1 if start >= 0 else size
            continue
        if m[1] or m[2]:
            at = _comment_end(html, m.end()) if m[1] else html.find(">", m.end()) + 1 or size
            continue
        end = _tag_end(html, m.end())
        if end < 0:  # a tag that never ends holds no text
            break
        tag, attrs, at = m[4].lower(), html[m.end() : end], end + 1
        if m[3]:
            depth = open_.depth((tag,))
            if depth and (tag not in _INLINE or open_.scope() <= depth):  # a stray end of an inline element ends no block
                open_.close(depth)
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style"):
                end = -1 if tag in unended else _raw_end(html, tag, at)
                if end < 0:
                    unended.add(tag)
                at = end if end >= 0 else size if tag in ("script", "style", "textarea") else at
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            depth = open_.depth(_CLOSES.get(tag, ("p",)))
            if depth and depth >= (open_.depth(("table",)) if tag in ("tr", "td", "th") else open_.scope()):
                open_.close(depth)
        child = Node(tag, attrs, open_.node)
        open_.node.children.append(child)
        if tag not in _VOID and not (attrs.endswith("/") and tag not in _INLINE and tag not in _SECTIONS):
            open_.push(child)
    return open_.root


def _measure(root: Node) -> list[Node]:
    """Sets text and linked lengths and points, cuts boilerplate off; returns the elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        kept = [c for c in node.children if isinstance(c, str) or not _boilerplate(c)]
        node.children, node.cut = kept, len(kept) < len(node.children)
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        own = sum(len(c) - c.isspace() * len(c) for c in node.children if isinstance(c, str))
        node.commas = sum(c.count(",") if isinstance(c, str) else c.commas for c in node.children)
        node.text = own + sum(c.text for c in node.children if not isinstance(c, str))
        node.linked = node.text if node.tag == "a" else sum(c.linked for c in node.children if not isinstance(c, str))
    for node in order:
        if node.tag in _INLINE:
            continue
        run = [c for c in node.children if isinstance(c, str) or c.tag in _INLINE]
        length = sum(len(c.strip()) if isinstance(c, str) else c.text for c in run)
        if not length:
            continue
        commas = sum(c.count(",") if isinstance(c, str) else c.commas for c in run)
        linked = sum(c.linked for c in run if not isinstance(c, str))
        points = (1 + commas + length / 100) * (1 - linked / max(length, linked))
        up, depth = (node if node.tag in _SECTIONS else node.parent or node), 1
        while up is not None and depth <= 3:
            up.points += points / depth
            up, depth = up.parent, depth + 1
    return order


def _menu(node: Node) -> bool:
    """A list of three links or more that is nearly nothing else, but for one inside an article or main with more other text."""
    if not (node.tag in ("ul", "ol", "dl") and node.text > 0 and node.linked > 0.8 * node.text and sum(not isinstance(c, str) for c in node.children) >= 3):
        return False
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is None or up.text - up.linked < node.text


def _blocks(node: Node) -> list[str]:
    """Text blocks of an element, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not _menu(x):
            if x.tag not in _INLINE:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def _whole(best: Node) -> Node:
    """The element that holds the whole article: the article or main around the best element, or its parent
    where that has parts of text only."""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.parent
    while (up := best.parent) is not None and not up.cut and not any(c.linked >= 0.5 * c.text for c in up.children if not isinstance(c, str) and c.text):
        best = up
    return best


def main_text(html: str | None) -> str:
    """The main text of one page: blocks joined by a line feed."""
    if not html:
        return ""
    order = _measure(parse(html))
    best = max(order, key=lambda n: n.points * (1.25 if n.tag in ("article", "main") else 1.0))
    if best.points <= 0:
        return "\n".join(_blocks(order[0]))
    best = _whole(best)
    if best.parent is None:
        return "\n".join(_blocks(best))
    out: list[str] = []
    before = True
    for x in best.parent.children:
        if isinstance(x, str):
            continue
        density = x.linked / x.text if x.text else 1
        if x is best:
            out += _blocks(x)
            before = False
        elif before and x.tag in ("h1", "h2"):
            out += _blocks(x)
        elif x.tag == best.tag == "article" and density < 0.2 and x.text >= 80:
            out += _blocks(x)
        elif x.points >= 0.2 * best.points and density < 0.5 or x.tag in ("p", "blockquote", "pre") and density < 0.3 and x.text >= 80:
            out += _blocks(x)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    chosen = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("html"))
    kinds = dict(chosen.dtypes)
    names = [id_col, url_col, "text", "n_chars"]
    return chosen.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
