"""A light tree of a page's block elements and text runs, and the features of its nodes.

The tree knows what extraction needs: which block element holds which run of text, in page order. Inline
elements only mark link text; scripts, styles, comments, the head and silent elements leave no nodes. Missing and
stray end tags are forgiven the way browsers do for paragraphs, list items and table cells; the head ends at the
first thing that cannot stand in it, and a silent element without an end tag at the next block.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Elements by the way they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|iframe|title|textarea"  # hold text only, up to their end tag
SILENT = frozenset("head template svg object canvas select button math audio video".split())
NESTED = frozenset("template svg object".split())  # silent elements that may hold their own kind
HEAD = frozenset("base basefont bgsound head html link meta noframes template".split())  # what leaves the head open
BLOCK = frozenset(
    """html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main
    nav header footer aside form fieldset blockquote pre figure figcaption address details summary center dialog menu
    hgroup search ins""".split()
)
CLOSES_P = BLOCK - {"html", "body", "ins"} | {"hr"}
AROUND_P = ("div", "td", "th", "li", "article", "section", "main", "blockquote", "body", "table")  # what an open paragraph isn't closed beyond
#: An element of the key's kind ends open elements of the value's kinds, up to the nearest of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "td", "th", "tbody", "tfoot"), ("table",)),
    "tbody": (("tr", "td", "th", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
}
# Tag families, by the elements in each.
FAMILIES = {
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "item": "li dt dd", "list": "ul ol dl menu", "table": "table thead tbody tfoot tr td th caption",
    "div": "div center details summary dialog", "section": "section", "article": "article", "main": "main", "nav": "nav search", "header": "header",
    "footer": "footer address", "aside": "aside ins", "form": "form fieldset", "quote": "blockquote pre figure figcaption", "body": "html body",
}
FAMILY = {tag: k for k, tags in enumerate(FAMILIES.values()) for tag in tags.split()}
INHERITED = [list(FAMILIES).index(x) for x in ("article", "main", "nav", "header", "footer", "aside", "form", "list", "table", "quote")]
# Words of class, id, role and label attributes, by what they tell.
CUES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip toolbar topnav subnav sitemap",
    "head": "header masthead topbar branding logo banner hero site head",
    "foot": "footer colophon copyright legal bottom foot contentinfo credits imprint",
    "side": "sidebar side aside rail widget widgets complementary secondary column",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp outbrain taboola banner commercial",
    "notice": "cookie cookies consent notice notification alert gdpr privacy modal popup overlay subscribe newsletter paywall signup message warning toast",
    "comment": "comment comments reply replies respond discussion disqus thread commentlist feedback responses reader readers",
    "related": "share sharing social related recommended recommendations trending popular more tags latest follow similar teaser",
    "form": "form search login signin register contact input field poll survey",
    "content": "content article post entry story body main text page single news prose markdown blog",
}
CUE = {}
for _k, _words in enumerate(CUES.values()):
    for _w in _words.split():
        CUE[_w] = CUE.get(_w, 0) | 1 << _k

#: What begins at a "<": a comment, a tag's name or another declaration.
MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
#: The rest of a tag: quotes count after "=" only, and one that is never closed is an ordinary character.
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for tag in RAW.split("|")}
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")
SPACE = re.compile(r"\s+")


def cues(attributes: str) -> int:
    """A bit per family of ``CUES`` met in the attributes."""
    bits = 0
    for m in ATTRIBUTE.finditer(attributes):
        for part in PART.findall(m[1] or m[2] or m[3] or ""):
            bits |= CUE.get(part.lower(), 0)
    return bits


@dataclass
class Page:
    """Nodes in page order; a run's ``text`` is set, an element's is None."""

    parent: list[int] = field(default_factory=list)
    family: list[int] = field(default_factory=list)
    cue: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    link: list[int] = field(default_factory=list)  # characters of link text in a run

    def add(self, parent: int, family: int, cue: int, text: str | None = None, link: int = 0) -> int:
        self.parent.append(parent)
        self.family.append(family)
        self.cue.append(cue)
        self.text.append(text)
        self.link.append(link)
        return len(self.parent) - 1


def tags(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None, is an end tag, attributes) of all markup, in page order; raw-text elements whole, without a tag.

    Every character is read once: a tag without an end runs to the end of the page, as it does in browsers.
    """
    at, n = source.find("<"), len(source)
    while at >= 0:
        m = MARK.match(source, at)
        if m is None:
            at = source.find("<", at + 1)
            continue
        tag, attributes = m[3], ""
        if m[1]:
            end = source.find("-->", m.end())
            end = end + 3 if end >= 0 else n
        elif tag is None:
            end = source.find(">", m.end()) + 1 or n
        else:
            tag, rest = tag.lower(), REST.match(source, m.end())
            end = rest.end() if rest else n
            attributes = source[m.end() : end - 1] if rest else ""
            if rest is None:
                tag = None
            elif tag in RAW_END and not m[2]:
                close = RAW_END[tag].search(source, end)
                tag, end = None, close.end() if close else n
        yield at, end, tag, bool(m[2]), attributes
        at = source.find("<", end)


class Open:
    """The open elements: (tag, block node written to) from the root on, and where each kind stands among them."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int]] = [("", root)]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.at[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, tags) -> int:
        """Place of the innermost open element of these kinds, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def outermost(self, tags, above: int) -> int:
        """Place of the outermost open element of these kinds beyond ``above``, 0 if there is none."""
        found = (places[k] for t in tags if (places := self.at.get(t)) and (k := bisect.bisect_right(places, above)) < len(places))
        return min(found, default=0)

    def cut(self, depth: int) -> tuple[bool, int]:
        """Close all from ``depth`` on; whether blocks were among them, and how many anchors."""
        anchors, block = 0, bool(self.blocks) and self.blocks[-1] >= depth
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            anchors += tag == "a"
            if tag in BLOCK:
                self.blocks.pop()
        return block, anchors


def _is_closed(source: str, tag: str, at: int, ends: dict[str, int]) -> bool:
    """Whether a silent element that begins before ``at`` has an end tag; ``ends`` keeps where end tags were found."""
    if tag in NESTED:
        if ends.get(tag, 0) < at:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            ends[tag] = m.start() if m else len(source)
        return ends[tag] < len(source)
    m = re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
    return m is not None and m[1] == "/"


def parse(source: str) -> Page:
    page = Page()
    root = page.add(-1, FAMILY["body"], 0)
    held = Open(root)
    stack = held.stack
    pieces: list[str] = []
    anchors = linked = 0
    mute = None  # place in the stack of the outermost silent element
    loose = False  # it has no end tag
    ends: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := SPACE.sub(" ", entities.unescape("".join(pieces))).strip():
                node = stack[-1][1]
                page.add(node, page.family[node], 0, text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal anchors, mute
        if held.blocks and held.blocks[-1] >= depth:  # what silent elements hold are no blocks of the page
            if mute is None or held.blocks[bisect.bisect_left(held.blocks, depth)] < mute:
                flush()
        if mute is not None and depth <= mute:
            mute = None
        anchors -= held.cut(depth)[1]

    done = 0
    for start, end, tag, closing, attributes in tags(source):
        if start > done and mute is not None and stack[mute][0] == "head" and not source[done:start].isspace():
            pop(mute)
        if start > done and mute is None:
            pieces.append(source[done:start])
            linked += (start - done) if anchors else 0
        done = end
        if tag is None:
            continue
        if closing:
            if place := held.last((tag,)):
                if tag in BLOCK or tag in SILENT or not held.blocks or held.blocks[-1] < place:  # an inline end tag does not end blocks
                    pop(place)
            elif tag == "p" and mute is None:
                flush()
            continue
        if mute is not None and (tag not in HEAD if stack[mute][0] == "head" else loose and (tag in BLOCK or tag == stack[mute][0])):
            pop(mute)
        alone = attributes.endswith("/")
        if mute is not None:
            if tag not in VOID and not alone:
                held.push(tag, stack[-1][1])
                anchors += tag == "a"
            continue
        if tag in SILENT:
            if not alone:
                mute, loose = len(stack), tag != "head" and not _is_closed(source, tag, done, ends)
                held.push(tag, stack[-1][1])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            pieces.append(" ")
            continue
        if tag in CLOSES_P and (place := held.outermost(("p",), held.last(AROUND_P))):
            pop(place)
        if tag in IMPLIED and (place := held.outermost(IMPLIED[tag][0], held.last(IMPLIED[tag][1]))):
            pop(place)
        if tag in BLOCK:
            flush()
            node = page.add(stack[-1][1], FAMILY[tag], cues(attributes) if attributes else 0)
            if not alone:
                held.push(tag, node)
        elif not alone:
            anchors += tag == "a"
            held.push(tag, stack[-1][1])
    if done < len(source) and (mute is None or stack[mute][0] == "head"):
        pieces.append(source[done:])
        linked += (len(source) - done) if anchors else 0
    flush()
    return page


N_FAMILIES, N_CUES = len(FAMILIES), len(CUES)


def node_features(page: Page) -> np.ndarray:
    """One row of numbers per node."""
    n = len(page.parent)
    parent = np.array(page.parent)
    up = np.maximum(parent, 0)
    is_run = np.array([t is not None for t in page.text])
    size = np.array([len(t) if t is not None else 0 for t in page.text], float)
    link = np.array(page.link, float)
    marks = np.array([len(PUNCTUATION.findall(t)) if t is not None else 0 for t in page.text], float)
    family = np.array(page.family)
    depth = np.zeros(n)
    own_flags = np.zeros((n, len(INHERITED) + N_CUES), bool)
    cue = np.array(page.cue)
    own_flags[:, : len(INHERITED)] = family[:, None] == np.array(INHERITED)
    own_flags[:, len(INHERITED) :] = (cue[:, None] >> np.arange(N_CUES)) & 1
    flags = own_flags.copy()
    total, links, punctuation, runs, children = size.copy(), link.copy(), marks.copy(), is_run.astype(float), np.zeros(n)
    paragraphs = np.zeros(n)
    index, parents = np.zeros(n), page.parent
    for i in range(1, n):  # parents come before their children
        p = parents[i]
        depth[i] = depth[p] + 1
        flags[i] |= flags[p]
        index[i] = children[p]
        children[p] += 1
    p_family = FAMILY["p"]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        total[p] += total[i]
        links[p] += links[i]
        punctuation[p] += punctuation[i]
        runs[p] += runs[i]
        paragraphs[p] += family[i] == p_family and not is_run[i]
    before = np.concatenate(([0.0], np.cumsum(size)[:-1]))
    whole = max(total[0], 1.0)
    density = links / np.maximum(total, 1)
    pairs = up * N_FAMILIES + family
    alike = np.bincount(pairs[1:], minlength=n * N_FAMILIES)[pairs] if n > 1 else np.zeros(n)
    columns = [
        is_run, depth, np.log1p(total), density, punctuation / np.maximum(total, 1), np.log1p(runs), np.log1p(total / np.maximum(runs, 1)),
        index, children[up], index / np.maximum(children[up], 1), alike, total / np.maximum(total[up], 1), total / whole, before / whole,
        density[up], np.log1p(total[up]), paragraphs[up], paragraphs, np.log1p(punctuation),
    ]
    tags = family[:, None] == np.arange(N_FAMILIES)
    return np.concatenate([np.stack(columns, 1).astype(np.float32), tags, own_flags[:, len(INHERITED) :], flags], axis=1, dtype=np.float32)
