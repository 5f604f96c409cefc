"""HTML extraction by wrappers inferred from the pages of a host.

A page is a token stream of start tags, end tags and text. Streams of one host are
aligned two at a time: tags that meet are shared, a text that meets another becomes a
slot, tags on one side only become an optional group, and neighbours of the same kind
fold into a repeated group. The result is a union-free regular expression, the host's
wrapper. Its elements are told apart once for the host: menus, notices, adverts and the
like are left out unless they hold most of its text, elements that mark an article are found, and
what is left is judged by the text and links its elements held over all pages. Each page is
then read along its wrapper, by the best mark that it has itself.

Pages first meet as shapes with added-up statistics, folded in the task; shapes are
aligned in bounded bunches, level by level, so a host with most of the pages is
spread like any other. Wrappers go back to the pages by a lookup that is broadcast
only if small.

Defined results: a null or empty page has empty text; a null URL and one without a host
are pages of the host ""; a page without text that belongs to the article is empty; pages may be
of any length, width and depth, elements below ``MAX_DEPTH`` being read as siblings;
repeated rows are read one by one; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.llm.common import ship
from moderata.operators.joins import lookup_join
from moderata.session import settle

# Shapes aligned in one group.
BUNCH = 64
# Without a marked article: an element whose text is mostly links is no content.
MAX_LINK_SHARE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by their role in the HTML standard.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var",
    # Formulas and the fallback of an object are text of the line they stand in.
    "math", "menclose", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow",
    "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover",
    "object", "param", "semantics",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_PARAGRAPH = HEADINGS | {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
HOLDS_SAME = {"ul", "ol", "menu", "dl", "table", "tbody", "select"}
# Parts of names that mark what is not the article.
OUTSIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "input"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu"}
OUTSIDE_NAMES = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "teaser",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "widget", "pagination", "pager", "toolbar",
    "copyright", "legal", "disclaimer",
}
# Outside names whose elements may well hold more text than the article.
TALK_NAMES = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
HEADER_NAMES = {"header", "masthead"}
# Names do not speak against these.
PAGE_TAGS = {"html", "body", "main"}
ARTICLE_NAMES = {"article", "articlebody", "post", "entry", "story", "content", "main", "body", "text"}

# Elements below this depth stand beside each other in the element at it, as in browsers' trees.
MAX_DEPTH = 256

# The keys of an element and those around it, outermost first.
Path = tuple[str, ...]


@dataclass
class Node:
    """An element of a page or of a wrapper; ``key`` is its tag with class, id and role.

    In a wrapper ``optional`` and ``repeated`` say how often it occurs, ``n_text`` and
    ``n_link`` how many characters of text and of links it held directly, over all pages.
    """

    key: str
    children: list[Node | str] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    n_text: int = 0
    n_link: int = 0

    @property
    def tag(self) -> str:
        return self.key.split(" ", 1)[0]


def _key(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop"):
            found.setdefault(name.lower(), " ".join(re.sub(r"\d+", "#", "".join(values)).split()))
    return " ".join([tag, *(f"{k}={v}" for k, v in sorted(found.items()) if v)])


def parse(page: str | None) -> Node:
    """The element tree of a page; texts are children, as (characters decoded) strings.

    End tags left out are put in where the HTML standard implies them, inline elements
    are dissolved, and a text inside a link begins with a mark. Elements nested deeper than
    ``MAX_DEPTH`` keep their texts and their order, but become siblings.
    """
    root = Node("")
    stack, links = [root], 0
    is_open: Counter[str] = Counter()
    text, at, page = "", 0, page or ""

    def add(child: Node | str) -> None:
        stack[min(len(stack), MAX_DEPTH) - 1].children.append(child)

    def flush() -> None:
        nonlocal text
        if text.strip(" \t\n\r\f\x01"):
            add(text)
        text = ""

    def close(tags: set[str], until: set[str]) -> None:
        if not any(is_open[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                is_open.subtract(n.tag for n in stack[depth:])
                del stack[depth:]
                return
            if stack[depth].tag in until:
                return

    while at < len(page):
        match = TOKEN.match(page, at)
        if match is None:
            break
        at = match.end()
        if match["text"] is not None:
            decoded = entities.unescape(match["text"])
            text += f"\x01{decoded}\x02" if links and decoded.strip() else decoded
            continue
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if match["end"] else 1
            continue
        if tag == "br":
            text += " "
            continue
        flush()
        links = 0
        if match["end"]:
            close({tag}, set())
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, ENDS_PARAGRAPH - {"p"})
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], HOLDS_SAME)
        node = Node(_key(tag, match["attributes"]))
        add(node)
        if tag not in VOID and not match["attributes"].endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    flush()
    return root


def _spaced(text: str) -> str:
    return " ".join(text.replace("\x01", "").replace("\x02", "").split())


def shape(node: Node) -> Node:
    """The trivial wrapper of a page: texts are slots, neighbours of a kind are folded."""
    made = Node(node.key)
    for child in node.children:
        if isinstance(child, str):
            made.n_text += len(_spaced(child))
            made.n_link += sum(len(_spaced(part)) for part in re.findall("\x01(.*?)\x02", child, re.S))
            if not made.children or made.children[-1] != "#":
                made.children.append("#")
        else:
            made.children.append(shape(child))
    made.children = _fold(made.children)
    return made


def _name(child: Node | str) -> str:
    return child if isinstance(child, str) else child.key


def _fold(children: list[Node | str]) -> list[Node | str]:
    """Neighbouring groups that repeat, up to three elements long, made one repeated group."""
    done: list[Node | str] = []
    for child in children:
        done.append(child)
        for size in (1, 2, 3):
            if len(done) < 2 * size:
                break
            first, second = done[-2 * size : -size], done[-size:]
            if [_name(c) for c in first] != [_name(c) for c in second] or all(isinstance(c, str) for c in first):
                continue
            merged: list[Node | str] = []
            for a, b in zip(first, second, strict=True):
                if isinstance(a, Node):
                    a = align(a, b)
                    a.repeated = True
                merged.append(a)
            done[-2 * size :] = merged
            break
    return done


def align(a: Node, b: Node) -> Node:
    """The wrapper of everything that either wrapper of an element describes."""
    made = Node(a.key, [], a.optional or b.optional, a.repeated or b.repeated, a.n_text + b.n_text, a.n_link + b.n_link)
    left, right = a.children, b.children
    names = [_name(c) for c in left], [_name(c) for c in right]
    if names[0] == names[1]:
        pairs = [(i, i) for i in range(len(left))]
    else:
        pairs = _common(*names)
    i = j = 0
    for x, y in [*pairs, (len(left), len(right))]:
        for lone in [*left[i:x], *right[j:y]]:
            if isinstance(lone, Node):
                lone.optional = True
            made.children.append(lone)
        if x < len(left):
            both = left[x]
            made.children.append(align(both, right[y]) if isinstance(both, Node) else both)
        i, j = x + 1, y + 1
    if names[0] != names[1]:
        made.children = _fold(made.children)
    return made


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory linear in the longer list.

    Row ``i`` is one number with a bit per place of ``b``, last place first: 0 where the length for
    ``a[i:]`` rises. A row follows from the next one by an addition, so 20,000 places a side take a moment. Only
    every ``step``-th row is kept; those between are made again on the way back.
    """
    width, step = len(b), isqrt(len(a)) + 1
    full = (1 << width) - 1
    places: dict[str, int] = defaultdict(int)
    for j, name in enumerate(b):
        places[name] |= 1 << (width - 1 - j)

    def before(row: int, name: str) -> int:
        hit = row & places.get(name, 0)
        return ((row + hit) | (row - hit)) & full

    def length(row: int, j: int) -> int:
        return width - j - (row & ((1 << (width - j)) - 1)).bit_count()

    kept, row = {len(a): full}, full
    for i in range(len(a) - 1, -1, -1):
        row = before(row, a[i])
        if i % step == 0:
            kept[i] = row
    pairs, j = [], 0
    for start in range(0, len(a), step):
        end = min(start + step, len(a))
        rows = [kept[end]]
        for name in reversed(a[start:end]):
            rows.append(before(rows[-1], name))
        rows.reverse()
        i = start
        while i < end and j < width:
            if a[i] == b[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif length(rows[i - start + 1], j) >= length(rows[i - start], j + 1):
                i += 1
            else:
                j += 1
    return pairs


def pattern(node: Node) -> str:
    """The wrapper as a union-free regular expression over tags and ``#`` for a text slot."""
    inner = "".join(c if isinstance(c, str) else pattern(c) for c in node.children)
    if not node.key:
        return inner
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}
    body = f"<{node.key}>{inner}</{node.tag}>"
    sign = mark[node.optional, node.repeated]
    return f"({body}){sign}" if sign else body


def dump(node: Node) -> list:
    """Nested lists for JSON; the statistics come second to last."""
    children = [c if isinstance(c, str) else dump(c) for c in node.children]
    return [node.key, int(node.optional), int(node.repeated), node.n_text, node.n_link, children]


def load(data: list) -> Node:
    key, optional, repeated, n_text, n_link, children = data
    made = [c if isinstance(c, str) else load(c) for c in children]
    return Node(key, made, bool(optional), bool(repeated), n_text, n_link)


def _names_of(key: str) -> tuple[set[str], set[str]]:
    """Lower-case name parts of class and id, and the roles, of an element key."""
    names, roles = set(), set()
    kind = ""
    for word in key.split(" ")[1:]:
        if "=" in word:
            kind, word = word.split("=", 1)
        (roles if kind == "role" else names).update([word.lower()] if kind == "role" else map(str.lower, PIECES.findall(word)))
    return names, roles


@lru_cache(maxsize=100_000)
def _marks(key: str) -> tuple[bool, frozenset[str]]:
    """Whether tag or role put an element outside, and the outside names it has."""
    tag = key.split(" ", 1)[0]
    names, roles = _names_of(key)
    return tag in OUTSIDE_TAGS or bool(roles & OUTSIDE_ROLES), frozenset(names & OUTSIDE_NAMES)


@lru_cache(maxsize=100_000)
def _led_by_mark(key: str) -> bool:
    """Whether a name of the element begins with an outside name, like "menu-top" but not "with-menu"."""
    values = [w.split("=", 1)[-1] for w in key.split(" ")[1:]]
    return any((pieces := PIECES.findall(v)) and pieces[0].lower() in OUTSIDE_NAMES for v in values)


def _outside(node: Node, path: Path, holders: set[Path]) -> bool:
    """Whether the element at ``path`` is no part of an article.

    Names count only where the element does not hold the article: not on the page's
    own elements, on an outermost article or on ``holders``.
    """
    always, names = _marks(node.key)
    if always or not names or node.tag in PAGE_TAGS or path in holders:
        return always
    return node.tag != "article" or any(_is_article(key) for key in path[:-1])


def holding_paths(wrapper: Node, by_page: bool = False) -> set[Path]:
    """Paths of elements with an outside name that hold most of the text outside links.

    With ``by_page`` the wrapper is that of a single page, which says less: a name must not begin
    with the outside name then.
    """
    found: set[Path] = set()

    def plain(node: Node) -> int:
        below = sum(plain(c) for c in node.children if isinstance(c, Node) and not _marks(c.key)[0])
        return node.n_text - node.n_link + below

    def walk(node: Node, path: Path, least: float) -> None:
        for child in node.children:
            if not isinstance(child, Node):
                continue
            always, names = _marks(child.key)
            if always or names & TALK_NAMES or plain(child) <= least:
                continue
            below = (*path, child.key)
            if names and not (by_page and _led_by_mark(child.key)):
                found.add(below)
            walk(child, below, least)

    walk(wrapper, (), plain(wrapper) / 2)
    return found


def _totals(node: Node, path: Path, holders: set[Path]) -> tuple[int, int]:
    """Characters of text and of links below an element, what is outside left out."""
    n_text, n_link = node.n_text, node.n_link
    for child in node.children:
        if isinstance(child, Node) and not _outside(child, below := (*path, child.key), holders):
            more = _totals(child, below, holders)
            n_text, n_link = n_text + more[0], n_link + more[1]
    return n_text, n_link


def _marked(node: Node, test, path: Path, holders: set[Path]) -> dict[Path, int]:  # noqa: ANN001  a predicate over element keys
    """Characters of text of the outermost elements that pass, none of them outside, by path."""
    found: dict[Path, int] = defaultdict(int)
    for child in node.children:
        if isinstance(child, Node) and not _outside(child, below := (*path, child.key), holders):
            more = {below: _totals(child, below, holders)[0]} if test(child.key) else _marked(child, test, below, holders)
            for at, n in more.items():
                found[at] += n
    return found


def _is_article(key: str) -> bool:
    return key.split(" ", 1)[0] == "article"


def _is_main(key: str) -> bool:
    return key.split(" ", 1)[0] == "main" or "main" in _names_of(key)[1]


def _is_named(key: str) -> bool:
    names, _ = _names_of(key)
    return bool(names & ARTICLE_NAMES)


def article_tiers(wrapper: Node, holders: set[Path]) -> list[tuple[set[Path], bool]]:
    """Paths of the elements that may hold the article on a host's pages, best first.

    Marked articles come first, then a main element, then names such as "content"; what is
    left is everything that is not mostly links. With each goes whether a page's element
    must hold most of its text: names are trusted only where they do, on the host or the page.
    """
    all_text = max(1, _totals(wrapper, (), holders)[0])
    tiers = []
    for test in (_is_article, _is_main, _is_named):
        found = _marked(wrapper, test, (), holders)
        held = sum(found.values())
        if held:
            tiers.append((set(found), test is _is_named and 2 * held <= all_text))
    return tiers


def _link_paths(node: Node, path: Path, holders: set[Path]) -> set[Path]:
    """Paths of the elements that are mostly links over all pages of a host."""
    found: set[Path] = set()
    for child in node.children:
        if isinstance(child, Node):
            below = (*path, child.key)
            n_text, n_link = _totals(child, below, holders)
            if n_text and n_link > MAX_LINK_SHARE * n_text:
                found.add(below)
            else:
                found |= _link_paths(child, below, holders)
    return found


class Reader:
    """Reads pages along a host's wrapper, each by the best mark of an article that it has."""

    def __init__(self, wrapper: Node, by_page: bool = False) -> None:
        self.by_page = by_page
        self.holders = holding_paths(wrapper, by_page)
        self.tiers = article_tiers(wrapper, self.holders)
        # Links inside a marked article belong to it.
        self.skipped = _link_paths(wrapper, (), self.holders)

    def blocks(self, page: Node) -> list[str]:
        for articles, must_lead in self.tiers:
            found = self._found(page, articles, set())
            if found and must_lead:
                whole = self._found(page, {()}, set())
                found = found if 2 * sum(map(len, found)) > sum(map(len, whole)) else []
            if found:
                return found
        found = self._found(page, {()}, self.skipped)
        if found or self.by_page:
            return found
        # All that the host's wrapper would read is outside; the page may have a template of its own.
        own = shape(page)
        return Reader(own, by_page=True).blocks(page) if holding_paths(own, by_page=True) else []

    def _found(self, page: Node, articles: set[Path], skipped: set[Path]) -> list[str]:
        found: list[str] = []
        self._read(page, (), articles, skipped, () in articles, False, found)
        return found

    def _read(
        self, node: Node, path: Path, articles: set[Path], skipped: set[Path], inside: bool, heading_only: bool, found: list[str]
    ) -> None:
        for child in node.children:
            if isinstance(child, str):
                text = _spaced(child) if inside and not heading_only else ""
                if text:
                    found.append(text)
                continue
            below = (*path, child.key)
            header = child.tag == "header"
            if below in skipped:
                continue
            if _outside(child, below, self.holders):
                always, names = _marks(child.key)
                # The header of an article may be marked by its name.
                if always or names - HEADER_NAMES or not (inside and (() not in articles or _is_named(child.key))):
                    continue
                header = True
            # A header names the page or the article: only headings of the article's own are its text.
            own = heading_only or header
            if child.tag in HEADINGS:
                own = False
            if header and not inside:
                continue
            self._read(child, below, articles, skipped, inside or below in articles, own, found)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _texts(data: list) -> list:
    """The shape without its statistics."""
    return [data[0], data[1], data[2], [c if isinstance(c, str) else _texts(c) for c in data[5]]]


def _added(a: Node, b: Node) -> None:
    """Add the statistics of an equal shape."""
    a.n_text, a.n_link = a.n_text + b.n_text, a.n_link + b.n_link
    for x, y in zip(a.children, b.children, strict=True):
        if isinstance(x, Node):
            _added(x, y)


SHAPES = "host string, wrapper string, n_pages bigint"


def shapes(pages: DataFrame) -> DataFrame:
    """Distinct shapes per host of ``pages(url, html)``, added up within each task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list] = {}
            for url, page in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                own = shape(parse(page))
                key = host(url), json.dumps(_texts(dump(own)))
                if key in seen:
                    _added(seen[key][0], own)
                    seen[key][1] += 1
                else:
                    seen[key] = [own, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in seen], pa.string()),
                    pa.array([json.dumps(dump(w)) for w, _ in seen.values()], pa.string()),
                    pa.array([n for _, n in seen.values()], pa.int64()),
                ],
                names=["host", "wrapper", "n_pages"],
            )

    return pages.select("url", "html").mapInArrow(fold, SHAPES)


def _aligned(part: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of the shapes of a bunch, aligned one after the other."""
    part = part.sort_values("wrapper", kind="stable")
    trees = [load(json.loads(w)) for w in part["wrapper"]]
    made = trees[0]
    for other in trees[1:]:
        made = align(made, other)
    return pd.DataFrame(
        {"host": [part["host"].iloc[0]], "wrapper": [json.dumps(dump(made))], "n_pages": [int(part["n_pages"].sum())]}
    )


def infer(pages: DataFrame, bunch: int = BUNCH) -> DataFrame:
    """``host, wrapper, n_pages``: one settled wrapper per host of ``pages(url, html)``.

    A host with more than ``bunch`` shapes is aligned in several groups first; each
    level divides the number of its shapes by about half of ``bunch``.
    """
    ship(pages.sparkSession)
    level = settle(shapes(pages))
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= 1:
            return level
        groups = F.ceil(F.col("n") / F.lit(bunch / 2)).cast("int")
        crowded = settle(sizes.where(F.col("n") > bunch).select("host", "n", groups.alias("groups")))
        keyed = lookup_join(level, crowded, ["host"], row_id=["wrapper"], matches="n", how="left", settled=True)
        dealt = F.coalesce(F.pmod(F.xxhash64("wrapper"), F.col("groups")), F.lit(0)).alias("bunch")
        level = settle(
            keyed.select("host", "wrapper", "n_pages", dealt).groupBy("host", "bunch").applyInPandas(_bunch, SHAPES)
        )


def _bunch(part: pd.DataFrame) -> pd.DataFrame:
    return _aligned(part.drop(columns="bunch"))


_READERS: dict[str, Reader] = {}


def _reader(wrapper: str) -> Reader:
    if wrapper not in _READERS:
        if len(_READERS) >= 1000:
            _READERS.clear()
        _READERS[wrapper] = Reader(load(json.loads(wrapper)))
    return _READERS[wrapper]


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    ``wrappers`` is the settled result of :func:`infer`. Blocks are joined by an empty line.
    """
    ship(pages.sparkSession)

    @F.pandas_udf(T.StringType())
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, wrapper in batches:
            yield pd.Series(
                [
                    "\n\n".join(_reader(w).blocks(parse(page))) if page and w else ""
                    for page, w in zip(html, wrapper, strict=True)
                ],
                dtype=object,
            )

    @F.pandas_udf(T.StringType())
    def host_of(urls: pd.Series) -> pd.Series:
        return urls.map(host, na_action=None)

    keyed = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    joined = lookup_join(
        keyed, wrappers, ["host"], row_id=["page_id"], matches="n_pages", how="left", settled=True
    )
    text = joined.select("page_id", "url", text_of("html", "wrapper").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Infer the wrappers of ``pages(page_id, url, html)`` and read every page along its own."""
    return extract(pages, infer(pages))


def patterns(wrappers: DataFrame) -> DataFrame:
    """``host, n_pages, pattern``: wrappers as union-free regular expressions."""
    ship(wrappers.sparkSession)

    @F.pandas_udf(T.StringType())
    def written(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: pattern(load(json.loads(w))))

    return wrappers.select("host", "n_pages", written("wrapper").alias("pattern"))
