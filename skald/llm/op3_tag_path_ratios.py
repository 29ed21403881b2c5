"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of block elements from the
root to it.  Text length, punctuation and linked text are added up per path
and divided by the path's nodes.  The length and punctuation ratios of the
blocks are smoothed over the page's order (Gaussian), fused by their product
with the unlinked share, and compared with the page's mean, weighted by text.
The paths' blocks that reach a share of it are content nodes.  They elect the
content subtree with their ratios: the deepest element that has most of them,
widened to parents that add only headings and further content nodes.  Short
paragraphs inside it are kept although they alone would not pass, and so are its
linked headings and lists, unless the subtree as a whole is made much of links.

What elements, roles, classes and ids say only weighs: inside menus, headers,
footers, asides, forms and the like a block's ratio counts less, and it is kept
only if it passes all the same.  Where such elements win the election with most
of the ratios, over a short article, it is held again without them.  A form
around an article or main heading is no such form.  Article and main elements
have no privilege.
Scripts, styles and other elements without text of the page are left out.

Reading and choosing take time and memory in proportion to the page, also for
pages nested deeply or full of tags that are never closed.

Defined results: null and empty html, and pages without content, give an empty
text; repeated rows are extracted row by row; unclosed and stray tags are
closed as HTML closes them; an unclosed comment, script or style takes the
rest of the page; an empty table gives no rows; extra columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import batches as B

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TO_END = frozenset("script style textarea title".split())
_NO_TEXT = frozenset("noscript template select iframe object svg math canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a start tag closes, and the elements that stop the search for it, by the name of the scope.
_SCOPE_OF = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_FENCES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "table": ("p", "tr", "td"), "tr": ("td",), "td": ("p",), "th": ("p",), "button": ("p",), "select": ("option",)}

_BOILER_TAGS = frozenset("nav aside footer form button dialog menu header head".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Parts of class names and ids of boilerplate, and parts that may stand beside them ("comment-list", "site-header").
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead banner "
    "footer comment comments respond reply replies disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login related "
    "discussion discussions thread threads recommended share sharing social toolbar pagination pager side".split()
)
_NEUTRAL_NAMES = frozenset(
    "area bar block body bottom box button buttons container content group icons inline inner item items left link links list main outer page panel post posts primary "
    "right row secondary section site slot top unit widget wrap wrapper".split()
)
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…](?!\S)|[、。，]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one paragraph and so cannot be a whole article.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd figcaption caption".split())


@dataclass(frozen=True)
class TagPathConfig:
    #: Standard deviation of the smoothing, in blocks.
    sigma: float = 1.0
    #: Share of the page's mean fused ratio that a content node must reach.
    threshold: float = 0.3
    #: Weight of a ratio inside a menu, header, footer, aside or form, and inside an element with such a role, class or id.
    tag_weight: float = 0.35
    named_weight: float = 0.05
    #: Share of the content nodes' ratios that the content subtree holds.
    majority: float = 0.75
    #: A path with more of its text in links than this is a menu, unless it is a part of a content subtree with fewer links than the next share.
    max_linked: float = 0.6
    subtree_linked: float = 0.4
    #: Menus, footers, forms and the like with more of the elected ratios than this lose their votes,
    besides_share: float = 0.5
    #: if there are so many characters outside of them.
    least_article: int = 20


@dataclass
class Block:
    text: str
    element: int
    path: int
    linked: int = 0


@dataclass
class Page:
    """Blocks in order; of each element its tag, parent, path, what ratios inside it weigh, what its names leave of that, and whether its tag says menu, footer or the like.  Element 0 is the page."""

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    weights: list[float] = field(default_factory=lambda: [1.0])
    named: list[float] = field(default_factory=lambda: [1.0])
    besides: list[bool] = field(default_factory=lambda: [False])


def weight_of(attributes: str, config: TagPathConfig) -> float:
    """What role, class and id leave of the ratios: less if they name boilerplate and nothing else beside it; nothing of hidden elements."""
    out = 1.0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            return 0.0
        if name in ("class", "id"):
            for token in value.split():
                parts = {x.lower() for x in _NAME_PARTS.findall(token)}
                if parts & _BOILER_NAMES and parts <= _BOILER_NAMES | _NEUTRAL_NAMES:
                    out = config.named_weight
        elif name == "role" and not _BOILER_ROLES.isdisjoint(value.lower().split()):
            out = config.named_weight
    return out


class _Scanner:
    """Finds the ends of tags; what is missing in the rest of the page is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag's ``>`` is that stands outside of attribute values, else the next ``>``; -1 without any."""
        i = at
        while m := _STOP.search(self.page, i) if ">" not in self.missing else None:
            if m.group() == ">":
                return m.start()
            i = m.end()
            if self.page[at : m.start()].rstrip()[-1:] == "=" if m.start() - at < 64 else self.page[m.start() - 64 : m.start()].rstrip()[-1:] == "=":
                close = self.find(m.group(), i)
                if close < 0:
                    break
                i = close + 1
        return self.find(">", at)

    def close_of(self, tag: str, at: int) -> int:
        """The end of the next end tag of this name; -1 without any."""
        key = f"</{tag}"
        if key in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        if not m:
            self.missing.add(key)
            return -1
        end = self.find(">", m.end())
        return end + 1 if end >= 0 else len(self.page)


def read_page(page: str, config: TagPathConfig) -> Page:
    """The blocks of a page in order, and its elements."""
    out, scan = Page(), _Scanner(page)
    known: dict[tuple[int, str, float], int] = {}
    stack, scopes = [0], [{}]  # open elements, and for each the nearest open p, li, ... as places in the stack
    open_: dict[str, int] = {}
    articles = 0
    links, parts, linked = 0, [], 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text and out.weights[stack[-1]]:
            out.blocks.append(Block(text, stack[-1], out.paths[stack[-1]], min(linked, len(text))))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw)
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def pop_to(place: int) -> None:
        nonlocal articles
        for e in stack[place:]:
            open_[out.tags[e]] -= 1
            articles -= out.tags[e] in ("article", "main")
        del stack[place:], scopes[place:]

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        closing = page.startswith("/", begin + 1)
        m = _NAME.match(page, begin + 1 + closing)
        if not m:
            if page.startswith("<!--", begin):
                end = scan.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            elif page[begin + 1 : begin + 2] in ("!", "?", "/") and (end := scan.find(">", begin)) >= 0:
                at = end + 1
            else:
                say("<")
                at = begin + 1
            continue
        end = scan.tag_end(m.end())
        if end < 0:
            say("<")
            at = begin + 1
            continue
        tag, attributes, at = m.group().lower(), page[m.end() : end], end + 1
        if not closing and (tag in _TO_END or tag in _NO_TEXT):
            if tag not in _INLINE:
                flush()
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                end = scan.close_of(tag, at)
                at = end if end >= 0 else n if tag in ("script", "style") else at
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if closing:
            if open_.get(tag, 0):
                place = len(stack) - 1
                while out.tags[stack[place]] != tag:
                    place -= 1
                pop_to(place)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and (place := scopes[-1].get("p", 0)):
            pop_to(place)
        scope = _SCOPE_OF.get(tag)
        if scope and (place := scopes[-1].get(scope, 0)):
            pop_to(place)
        if tag == "tr" and (place := scopes[-1].get("td", 0)):
            pop_to(place)
        parent = stack[-1]
        named = weight_of(attributes, config) if attributes and tag not in ("html", "body", "article", "main") else 1.0
        besides = tag in _BOILER_TAGS and not (tag == "header" and articles)
        weight = min(out.weights[parent], named, config.tag_weight if besides else 1.0)
        key = out.paths[parent], tag, weight
        out.tags.append(tag)
        out.parents.append(parent)
        out.paths.append(known.setdefault(key, len(known) + 1))
        out.weights.append(weight)
        out.named.append(named)
        out.besides.append(besides)
        stack.append(len(out.tags) - 1)
        open_[tag] = open_.get(tag, 0) + 1
        articles += tag in ("article", "main")
        inner = scopes[-1]
        if scope or tag in _FENCES:
            inner = {**inner, **dict.fromkeys(_FENCES.get(tag, ()), 0)}
            if scope:
                inner[scope] = len(stack) - 1
        scopes.append(inner)
    flush()
    return out


def beside_article(page: Page, config: TagPathConfig) -> list[bool]:
    """For each element, whether it or one around it is a menu, footer, form or the like.

    A form around an article or main heading is no such element, and what is in
    it weighs as if it were not there.
    """
    holds = [tag in ("article", "main", "h1") for tag in page.tags]
    for e in range(len(holds) - 1, 0, -1):
        holds[page.parents[e]] |= holds[e]
    out = [False] * len(holds)
    for e in range(1, len(holds)):
        parent = page.parents[e]
        own = page.besides[e] and not (page.tags[e] == "form" and holds[e])
        out[e] = out[parent] or own
        page.weights[e] = min(page.weights[parent], page.named[e], config.tag_weight if own else 1.0)
    return out


def fused_ratios(page: Page, config: TagPathConfig) -> np.ndarray:
    """The smoothed and fused tag-path ratio of each block, before names weigh."""
    sums: dict[int, list[float]] = {}
    for b in page.blocks:
        total = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        total[0] += len(b.text)
        total[1] += len(_PUNCTUATION.findall(b.text))
        total[2] += b.linked
        total[3] += 1
    rows = [sums[b.path] for b in page.blocks]
    length = np.array([r[0] / r[3] for r in rows])
    points = np.array([(r[1] + 1) / r[3] for r in rows])
    free = np.array([1 - r[2] / r[0] for r in rows])
    reach = min(int(np.ceil(3 * config.sigma)), max(len(rows) - 1, 0))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / config.sigma) ** 2)

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, kernel, "same") / kernel.sum() if len(rows) > 2 * reach else x

    return smooth(length) * smooth(points) * free


def _content_subtree(page: Page, content: np.ndarray, ratios: np.ndarray, config: TagPathConfig) -> int:
    """The element elected by the content nodes with their ratios."""
    votes, strange = [0.0] * len(page.tags), [0] * len(page.tags)
    for b, good, ratio in zip(page.blocks, content.tolist(), ratios.tolist()):
        if good:
            votes[b.element] += ratio
        elif page.tags[b.element] not in _HEADINGS or page.weights[b.element] < 1:
            strange[b.element] += 1
    for e in range(len(votes) - 1, 0, -1):
        votes[page.parents[e]] += votes[e]
        strange[page.parents[e]] += strange[e]
    chosen = 0
    for e, tag in enumerate(page.tags):
        if tag not in _LEAVES and votes[e] >= config.majority * votes[0]:
            chosen = e
    # What a parent adds may be headings and content nodes only.
    while chosen and strange[page.parents[chosen]] == strange[chosen]:
        chosen = page.parents[chosen]
    return chosen


def main_text(html: str | None, config: TagPathConfig = TagPathConfig()) -> str:
    """The main text of one page."""
    page = read_page(html or "", config)
    if not page.blocks:
        return ""
    ratios = fused_ratios(page, config)
    sizes = np.array([len(b.text) for b in page.blocks], float)
    links = np.array([b.linked for b in page.blocks])
    beside = beside_article(page, config)
    besides = np.array([beside[b.element] for b in page.blocks])
    weights = np.array([page.weights[b.element] for b in page.blocks])
    linked: dict[int, list[int]] = {}
    for b in page.blocks:
        total = linked.setdefault(b.path, [0, 0])
        total[0] += b.linked
        total[1] += len(b.text)
    menu = np.array([linked[b.path][0] > config.max_linked * linked[b.path][1] for b in page.blocks])
    weighted = weights * ratios
    voters = np.ones(len(sizes), bool)
    while True:
        content = voters & (weighted > 0) & (weighted >= config.threshold * np.average(ratios[voters], weights=sizes[voters]))
        kept = content | (voters & (weights == 1) & ~menu)
        if not content.any():
            return " ".join(b.text for b, good in zip(page.blocks, kept.tolist()) if good)
        chosen = _content_subtree(page, content, weighted, config)
        inside = [e == chosen for e in range(len(page.tags))]
        for e in range(chosen + 1, len(inside)):
            inside[e] = inside[page.parents[e]]
        within = np.array([inside[b.element] for b in page.blocks])
        elected = np.where(content & within, weighted, 0)
        # A menu, footer or form that outdoes a short article has no vote.
        plain = ~besides & (weights == 1) & ~menu
        if elected[besides].sum() <= config.besides_share * elected.sum() or sizes[plain].sum() < config.least_article or not voters[besides].any():
            break
        voters = ~besides
    own = voters & (weights == 1) & within
    if links[own].sum() <= config.subtree_linked * sizes[own].sum():
        kept |= own  # linked headings and lists of an article are the article's
    return " ".join(b.text for b, good in zip(page.blocks, (kept & within).tolist()) if good)


def extract_text(pages: DataFrame, config: TagPathConfig = TagPathConfig(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars."""

    def run(it):
        for rows, _, _ in B.chunks(it, html_column, 1 << 20):
            texts = [main_text(h, config) for h in B.column_of(rows, html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [B.column_of(rows, id_column), B.column_of(rows, url_column), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_column, url_column, "text", "n_chars"],
            )

    out = T.StructType([pages.schema[id_column], pages.schema[url_column], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return B.map_batches(pages.select(id_column, url_column, html_column), run, out)
