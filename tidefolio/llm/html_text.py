"""Main text of HTML pages by tag-path ratios.

Text length and punctuation are summed per root-to-leaf tag path and divided
by the path's nodes. Both ratios are smoothed along the page, fused to their
product, and the paths above a share of its spread are content. The content
nodes name the smallest container that holds most of them, or all containers of
its kind beside each other; what stands in it is the article, less what is
marked as page furniture. A mark counts by how plain it is and never takes out
what holds most of the page's text. Inside `article` and `main` all text is
kept whatever its path's ratio: short lists and captions there belong to the
article. Pages are parsed one by one; nothing is cut short.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefolio.llm.text import others, schema_with

SIGMA = 1.0  # of the smoothing, in text nodes
SPREAD = 0.5  # share of the fused ratio's standard deviation that content must reach
MOST = 0.6  # share of the content that a container must hold to be entered
ALONE = 0.95  # share of it that one of several containers of a path must hold to be entered alone

#: fixed values: HTML's element names by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: a start tag that ends open elements, and the elements beyond which it does not look
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
FURNITURE = frozenset(
    "head nav header footer aside form button select input datalist fieldset menu dialog svg canvas object applet audio video map math script style noscript template textarea iframe".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    """ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice
    notification alert newsletter subscribe subscription signup login comment comments disqus respond reply replies sidebar widget widgets share sharing social
    related recommended breadcrumb breadcrumbs menu nav navbar navigation topbar masthead header footer pagination pager toolbar copyright skip
    disclaimer legal adslot adunit adbox adcontainer paywall""".split()
)
#: fixed values: words that do not change what a mark beside them means
NEUTRAL = frozenset(
    """site page post posts main global top bottom left right inner outer wrap wrapper container box block section area bar list links link item items panel
    module unit slot button buttons icon icons form content body text title mobile desktop primary secondary sticky fixed""".split()
)
NEVER = frozenset("html body main".split())
WHOLE_PAGE = frozenset("form fieldset".split())  # furniture unless they hold most of the page
WEAK, PLAIN, GONE = 1, 2, 3
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption".split()) | INLINE

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(eq=False)
class Element:
    tag: str
    path: int  # number of the root-to-element tag path
    parent: Element | None
    mark: int  # 0, or how plainly it is marked as furniture
    held: int = 0  # length of the text below
    furniture: bool = False  # it or what it stands in is taken out
    holder: Element = field(init=False)  # container around the block that the element is or stands in
    chosen: float = 0.0  # length of the content below
    inside: bool = False  # of the content's container

    def __post_init__(self) -> None:
        self.holder = self.parent.holder if self.parent and self.tag in LEAVES else self


@dataclass
class Node:
    text: str
    element: Element
    block: int
    length: int = field(init=False)
    points: int = field(init=False)

    def __post_init__(self) -> None:
        self.length = len(self.text.strip())
        self.points = sum(unicodedata.category(c)[0] == "P" for c in self.text) if not self.text.isalnum() else 0


def mark_of(tag: str, attributes: str) -> int:
    """How plainly an element is marked as something else than the article.

    A class name or id of marks and neutral words is plain, one where a mark
    stands beside other words is weak. Paragraphs, headings and other leaves
    are named for their contents: only a plain class counts there.
    """
    if tag in FURNITURE:
        return PLAIN if tag in WHOLE_PAGE else GONE
    if tag in NEVER or not attributes.strip():
        return 0
    found = 0
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, text = name.lower(), "".join(value).lower()
        if name == "hidden" or name == "aria-hidden" and text == "true" or name == "style" and "display:none" in text.replace(" ", ""):
            return GONE
        if name == "role" and text in ROLES:
            found = PLAIN
        if name == "class" or name == "id" and tag not in LEAVES:
            for one in text.split():
                words = set(_SPLIT.split(one)) - {""}
                if not MARKS.isdisjoint(words):
                    found = max(found, PLAIN if words <= MARKS | NEUTRAL else WEAK)
    return 0 if found == WEAK and (tag in LEAVES or tag == "article") else found


def take_out_furniture(nodes: list[Node], elements: list[Element]) -> list[Node]:
    """The nodes outside furniture; a weak mark inside an article, and one on what holds most of the text, is passed over."""
    for n in nodes:
        n.element.held += n.length
    for e in reversed(elements):
        if e.parent and e.mark != GONE:
            e.parent.held += e.held
    enough = MOST * elements[0].held
    within: set[Element] = set()  # articles and what stands in them
    for e in elements:
        weak = e.mark == WEAK and e.parent in within
        e.furniture = bool(e.parent and e.parent.furniture) or e.mark == GONE or (e.mark > 0 and not weak and e.held < enough)
        if e.tag in ("article", "main") or e.parent in within:
            within.add(e)
    return [n for n in nodes if not n.element.furniture]


def text_nodes(page: str) -> tuple[list[Node], list[Element]]:
    """Text nodes and elements in page order; raw text is left out.

    Each step looks at the open elements only if one it may end is open, so
    deep pages take time in proportion to their length too.
    """
    nodes: list[Node] = []
    elements = [Element("", 0, None, 0)]
    stack, block, at = list(elements), 0, 0
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    pending: list[str] = []
    last = max(page.rfind(">"), page.rfind("<!--"))  # beyond it no tag ends

    def end_from(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def close(tags: set[str], fence: set[str]) -> None:
        """End the outermost open element of the tags above the fence, with all in it."""
        found = 0
        for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in tags) else ():
            if stack[i].tag in fence:
                break
            if stack[i].tag in tags:
                found = i
        if found:
            end_from(found)

    def flush() -> None:
        if pending:
            text = entities.unescape("".join(pending))
            if text:
                nodes.append(Node(text, stack[-1], block))
            pending.clear()

    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:
            pending.append(page[at:])
            break
        pending.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            pending.append("<")
            at = start + 1
            continue
        at, tag = m.end(), m[2].lower()
        flush()
        if tag not in INLINE:
            block += 1
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    end_from(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray end tag of a phrase ends no block
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?![a-z0-9])", re.I).search(page, at)
            at = len(page) if not end else end.start()
            if end:
                shut = page.find(">", at)
                at = len(page) if shut < 0 else shut + 1
            continue
        up = stack[-1]
        path = paths.setdefault((up.path, tag), len(paths) + 1)
        stack.append(Element(tag, path, up, mark_of(tag, m[3])))
        elements.append(stack[-1])
        opened[tag] += 1
    flush()
    return nodes, elements


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average along the page; the kernel is cut at its ends."""
    r = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def content_paths(nodes: list[Node], sigma: float = SIGMA, spread: float = SPREAD) -> set[int]:
    """Tag paths whose fused ratio reaches the threshold."""
    paths, place = np.unique([n.element.path for n in nodes], return_inverse=True)
    count = np.bincount(place)
    length = np.bincount(place, [n.length for n in nodes]) / count
    points = np.bincount(place, [n.points for n in nodes]) / count
    fused = smoothed(length[place], sigma) * smoothed(points[place], sigma)
    if not fused.any():
        fused = smoothed(length[place], sigma)
    of_path = np.bincount(place, fused * (length[place] > 0)) / count
    return set(paths[(of_path >= spread * fused.std()) & (of_path > 0)].tolist())


def main_text(page: str | None) -> str:
    """The article of a page; empty for null or a page without text."""
    nodes, elements = text_nodes(page or "")
    nodes = take_out_furniture(nodes, elements)
    real = [n for n in nodes if n.length]
    if not real:
        return ""
    paths = content_paths(real)
    holders = set()  # containers that hold content, next to which may stand what is short
    for n in real:
        if n.element.path in paths:
            n.element.chosen += n.length
            holders.add(n.element.holder)
    children: dict[Element, list[Element]] = {}
    for e in reversed(elements):  # parents come before their children
        if e.parent and e.chosen:
            e.parent.chosen += e.chosen
            children.setdefault(e.parent, []).append(e)
    root, roots = elements[0], [elements[0]]
    total = root.chosen
    while len(roots) == 1 and root.tag not in ("article", "main"):
        best = max(reversed(children.get(root, [])), key=lambda e: e.chosen, default=None)
        alike = [e for e in children.get(root, []) if best and e.path == best.path]
        held = sum(e.chosen for e in alike)
        if best is None or best.tag in LEAVES or held < MOST * total:
            break
        if len(alike) > 1 and best.tag not in ("article", "main") and best.chosen < ALONE * held:
            break  # parts of one article: their container is the article, with what heads them
        roots = alike if best.tag in ("article", "main") else [best]
        root = best
    entered = set(roots)
    for e in elements:
        e.inside = e in entered or bool(e.parent and e.parent.inside)
    whole = root.tag in ("article", "main")
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        e = n.element
        if e.inside and (whole or e.path in paths or e.holder in holders):
            blocks.setdefault(n.block, []).append(n.text)
    return " ".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages and text, n_chars (code points); columns of those names are replaced.

    Character references are decoded, white space in a block becomes one
    space, blocks are joined by one space in page order. Null html counts as
    empty and gives an empty text. Rows are read alone, so repeated rows
    agree; an empty table gives no row. Pages of any length are read whole.
    """
    rest = others(pages, ("text", "n_chars"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(batch.schema.get_field_index(html))]
            held = [batch.column(i) for i in range(len(rest))]
            yield pa.record_batch([*held, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*rest).mapInArrow(work, schema_with(pages, rest, "text string, n_chars long"))
