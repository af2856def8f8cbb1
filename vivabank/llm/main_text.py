"""Main text of web pages by rules on blocks, in two passes.

A page is cut into blocks at its block-level tags. What the markup says comes first: navigation, adverts,
notices, forms and the like are out, whatever their words. The first pass decides every other block by
itself: many links make it boilerplate, a long block with the stop words of running text is good. Short
blocks, and those in between, are left open. In the second pass an open block takes the label of the
nearest decided block before or behind it; a heading takes that of what follows it.

If the page marks its article, blocks outside are out, and inside the border of the article counts as a
good neighbour: a paragraph of odd words or a short one is not lost there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .batches import annotate

#: Blocks from LONG characters on are decided by their stop words, shorter ones than SHORT never are.
SHORT, LONG = 70, 200
#: Share of stop words of running text, and the least that leaves a block open; share of characters in links that makes it boilerplate.
STOP_HIGH, STOP_LOW, LINKED = 0.25, 0.12, 0.4

#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for was on are with as be by this it or from at an not have he his they we you but had which
    le la les de des du et un une que qui dans est pour pas sur au avec il elle ce ne se plus par sont aux nous vous leur
    el los las y en del con para por no una su al lo como más pero sus es son fue ha muy sin sobre
    der die das und den von zu mit ist im sich des auf für ein eine nicht dem als auch es an werden aus er hat dass sie nach bei
    """.split()
)

# Elements whose content is text for the parser, whatever it looks like.
_RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section
    select summary table tbody td template tfoot th thead tr ul
    """.split()
)
_OUT_TAGS = frozenset(
    "nav header footer aside form noscript template select button dialog menu svg math object canvas audio video fieldset search".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id that name something else than the article.
OUT_WORDS = frozenset(
    """
    nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar sidenav aside ad ads advert adverts
    advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment
    comments commentlist commentform discussion disqus respond replies widget pagination pager toolbar copyright disclaimer form search
    hidden skip adsbygoogle googleads
    """.split()
)
# Of an article element only these: it may bear the name of its page's layout.
_OUT_ARTICLES = frozenset("comment comments reply replies related recommended teaser promo ad advert sponsored".split())
# "has-sidebar" speaks of the page, not of the element.
_ABOUT = frozenset("has with no without".split())
_MAIN_NAMES = frozenset(
    """
    content main main-content maincontent article article-body article-content article-text post post-content post-body entry-content
    entry story story-body page-content mw-content-text
    """.split()
)
# Where the article is marked, from the surest sign to the vaguest.
_ARTICLE, _MAIN, _NAMED = 1, 2, 3

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))             # comment
    | <[!?][^>]*+(?:>|\Z) | </(?![a-zA-Z])[^>]++(?:>|\Z) | </>   # declarations, and what reads as a comment
    | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)
      (?P<attributes>(?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW}


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    links: int
    tag: str  # the innermost block-level element
    out: bool  # by its markup
    marks: int  # bits of the signs of an article around it
    good: bool | None = None


def _kind(name: str, attributes: str, marks: int) -> tuple[bool, int, bool]:
    """(whether an element is out, by its markup; its sign of an article, or 0; whether it is an article's own header)."""
    out, mark = name in _OUT_TAGS, {"article": _ARTICLE, "main": _MAIN}.get(name, 0)
    inside = bool(marks & (1 << _ARTICLE))
    head = inside and name == "header"
    words: set[str] = set()
    if attributes and not attributes.isspace() and name not in ("html", "body"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                own = {w.lower() for w in _PIECES.findall(value)}
                if not own & _ABOUT:
                    words |= own
                if not _MAIN_NAMES.isdisjoint(value.lower().split()):
                    mark = mark or _NAMED
            elif key == "role":
                out |= value.lower() in _OUT_ROLES
                mark = mark or {"main": _MAIN, "article": _ARTICLE}.get(value.lower(), 0)
            elif key == "itemprop" and value.lower() in ("articlebody", "comment"):
                mark, out = _ARTICLE, out or value.lower() == "comment"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "style" and "display:none" in value.lower().replace(" ", ""):
                out = True
    if inside and "header" in words:
        head = True
        words.remove("header")
    if name not in _HEADINGS and words & (_OUT_ARTICLES if name in ("article", "main") else OUT_WORDS):
        out = True
    out = out and not (head and name == "header")
    return out, 0 if out else mark, head


class _Page:
    """Walks the tags of a page, with the state of the elements around the current place."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        # Name, and the state in front of the element: out, marks, block, head.
        self.stack: list[tuple[str, tuple[bool, int, str, bool]]] = []
        self.open: Counter[str] = Counter()
        self.state = (False, 0, "body", False)
        self.parts: list[str] = []
        self.linked = self.links = 0

    def close(self) -> None:
        """End the current block."""
        text = " ".join("".join(self.parts).split())
        out, marks, block, head = self.state
        if text:
            # Of an article's own header only the headings belong to the text.
            self.found.append(Block(text, self.linked, self.links, block, out or (head and block not in _HEADINGS), marks))
        self.parts.clear()
        self.linked, self.links = 0, int(self.open["a"] > 0)

    def say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.open["a"]:
            self.linked += len(text) - text.count(" ")

    def leave(self, names: tuple[str, ...], through_blocks: bool) -> None:
        """Close the innermost open element of ``names`` and all in it, unless a block lies between."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name, before = self.stack[i]
            if name in names:
                if before[:2] != self.state[:2]:
                    self.close()
                self.state = before
                for gone, _ in self.stack[i:]:
                    self.open[gone] -= 1
                del self.stack[i:]
                return
            if name in _BLOCK and not through_blocks:
                return

    def enter(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self.close()
            # A paragraph or an item that was left open ends here.
            self.leave(("p", *_ITEMS.get(name, ())), False)
        if name in _VOID:
            return
        out, marks, block, head = self.state
        is_out, mark, is_head = _kind(name, attributes, marks)
        if (is_out, mark) != (False, 0):
            self.close()
        if name == "a" and "href" not in attributes.lower():
            return
        self.stack.append((name, self.state))
        self.open[name] += 1
        self.links += name == "a"
        # What was never closed before the main part does not hold it.
        out = is_out or (out and name != "main")
        self.state = (out, marks | (1 << mark if mark else 0), name if name in _BLOCK else block, head or is_head)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, with their white space made single blanks. Empty ones are left out."""
    walk = _Page()
    at, size = 0, len(page)
    while at < size:
        match = _MARKUP.search(page, at)
        end = match.start() if match else size
        if end > at:
            walk.say(page[at:end])
        if match is None:
            break
        at, name = match.end(), (match["name"] or "").lower()
        if match["end"]:
            if name in _BLOCK:
                walk.close()
            walk.leave((name,), name in _BLOCK)
        elif name in _RAW:
            closing = _RAW_END[name].search(page, at)
            at = closing.end() if closing else size
        elif name == "br":
            walk.parts.append("\n")
        elif name:
            walk.enter(name, match["attributes"])
    walk.close()
    return walk.found


def _first_pass(block: Block, inside: bool) -> bool | None:
    """Whether a block is good by itself; None leaves it open."""
    length = len(block.text)
    if block.linked > LINKED * length:
        # Inside an article a linked paragraph may be a sentence of it, a linked list item is not.
        return None if inside and block.links < 2 and block.tag not in ("li", "td", "dd") else False
    if not inside and (block.text.startswith("©") or (length < SHORT and block.linked)):
        return False
    if length < SHORT:
        return None
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()%*$#&") in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH and length >= LONG:
        return True
    return None if inside or stops >= STOP_LOW else False


def label(found: list[Block]) -> None:
    """Set ``good`` of every block."""
    usable = [b for b in found if not b.out]
    sign = next((s for s in (_ARTICLE, _MAIN, _NAMED) if any(b.marks >> s & 1 for b in usable)), 0)
    for b in found:
        b.good = False
    region = [b for b in usable if not sign or b.marks >> sign & 1]
    first = [_first_pass(b, bool(sign)) for b in region]
    # Nearest decided label and its distance, from each side; the border is good inside an article and bad elsewhere.
    border, far = bool(sign), len(region) + 1
    before, behind = [], []
    for labels, out in ((first, before), (first[::-1], behind)):
        last, distance = border, 0 if sign else far
        for own in labels:
            distance += 1
            if own is not None:
                last, distance = own, 0
            out.append((last, distance))
    behind.reverse()
    for i, b in enumerate(region):
        if first[i] is not None:
            b.good = first[i]
            continue
        (left, d), (right, e) = before[i], behind[i]
        if left == right:
            b.good = left
        elif b.tag in _HEADINGS:
            b.good = right
        else:
            # Between a good and a bad one the nearer counts; inside an article the good one does.
            b.good = bool(sign) or (left if d < e else right if e < d else False)


def main_text(page: str) -> str:
    """The good blocks of a page, in order, joined by one blank."""
    found = blocks(page)
    label(found)
    return " ".join(b.text for b in found if b.good)


def extract_pages(pages: DataFrame, source: str = "html", keep=None) -> DataFrame:
    """Add ``text`` (the main text of the column ``source``) and ``n_chars`` (its code points) to every row.

    Whole pages are read, one at a time. A null or empty page, and one without main text, has the empty
    text. Repeated rows are handled each; columns with the added names are replaced.
    """

    def factory():
        def compute(texts: list[bytes]):
            made = [main_text(t.decode("utf-8", "replace")) for t in texts]
            return [made, [len(t) for t in made]]

        return compute

    return annotate(pages, factory, "text string, n_chars long", text=source, keep=keep)
