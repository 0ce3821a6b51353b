"""A page as a sequence of tokens and blocks of text, in one linear pass over its HTML.

A token is a tag, known by the names and classes of the elements around it, or the
text of a whole block.  End tags that HTML lets authors leave out are implied; an end tag
without a start is ignored; an unfinished tag or comment reaches to the end.
Scripts, styles, titles and other elements that show no prose are skipped whole.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import xxhash

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*+)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that do not end a block of text.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup td th time tt u var wbr".split()
)
#: What an open element of this name is ended by.
_ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
        "menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Names that a new element cannot look past for something to end.
_SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote td th button".split())
#: Elements that are not the article wherever they stand.
_ASIDE = frozenset(
    "nav footer aside form dialog menu noscript template svg math button select datalist object canvas audio video head "
    "script style textarea title xmp iframe noembed noframes".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name something beside the article.
_BESIDE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments disqus "
    "reply replies respond share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar copyright".split()
)
_NEGATED = frozenset("no has with without".split())

#: Elements nested deeper than this belong to the one at this depth, which keeps reading linear.
DEEPEST = 512

ARTICLE, MAIN, OTHER, BESIDE = range(4)


@dataclass
class Block:
    """Text of a block; ``region`` says where it stands, ``linked`` how many of its characters are links."""

    text: str
    region: int
    linked: int
    token: int
    #: Tokens before its own in the sequence.
    at: int


@dataclass
class Page:
    #: Tokens in page order: even numbers are tags, odd ones texts of blocks.
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def article(self) -> int:
        """The region that holds the article: the first of article, main element and rest that has text."""
        return min((b.region for b in self.blocks), default=OTHER)


def _words(value: str) -> list[str]:
    found = _NAME.split(value.lower())
    return [w for before, w in zip(["", *found], found) if before not in _NEGATED]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        #: (name, hash of the path, region, links, inside an article element)
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, OTHER, False, False)]
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.links: list[str] = []

    def end_block(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        linked = sum(len("".join(x.split())) for x in self.links)
        self.pieces, self.links = [], []
        if not text:
            return
        _, path, region, _, _ = self.block
        token = _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path) | 1)
        self.page.blocks.append(Block(text, region, linked, token, len(self.page.tokens)))
        self.page.tokens.append(token)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top[2] == BESIDE or not raw:
            return
        if not self.pieces:
            self.block = next(e for e in reversed(self.stack) if e[0] not in _INLINE)
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if top[3]:
            self.links.append(text)

    def close_top(self) -> None:
        name, path, _, _, _ = self.stack.pop()
        self.open[name] -= 1
        if name not in _INLINE:
            self.end_block()
        self.page.tokens.append(_signed((path * 0x9E3779B97F4A7C15 + 2) & 0xFFFFFFFFFFFFFFFE))

    def end(self, name: str) -> None:
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self.close_top()
            self.close_top()

    def imply(self, name: str) -> None:
        """End what a new element of this name ends."""
        for k in range(len(self.stack) - 1, 0, -1):
            opened = self.stack[k][0]
            if name in _ENDED_BY.get(opened, ()):
                while len(self.stack) > k:
                    self.close_top()
                if opened in ("p", "li", "dt", "dd", "option"):
                    return
            elif opened in _SCOPE and not (opened in ("td", "th") and name in ("tr", "tbody", "tfoot")):
                return

    def start(self, name: str, rest: str) -> None:
        attributes = {}
        if rest and not rest.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(rest):
                attributes.setdefault(key.lower(), a or b or c)
        if name == "br":
            self.text(" ")
        elif name in ("td", "th"):
            self.text(" ")
        elif name not in _INLINE:
            self.end_block()
        if name not in _INLINE or name in ("td", "th"):
            self.imply(name)
        _, path, region, links, inside = self.stack[-1]
        label = _DIGITS.sub("", f"{name}.{attributes.get('class') or ''}")
        path = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), path)
        self.page.tokens.append(_signed(path & 0xFFFFFFFFFFFFFFFE))
        if name in _VOID:
            if name == "hr":
                self.end_block()
            return
        if len(self.stack) > DEEPEST:
            return
        if region != BESIDE:
            region, inside = self.region(name, attributes, region, inside)
        self.stack.append((name, path, region, links or name == "a", inside))
        self.open[name] = self.open.get(name, 0) + 1

    @staticmethod
    def region(name: str, attributes: dict, region: int, inside: bool) -> tuple[int, bool]:
        role = (attributes.get("role") or "").lower()
        if name in _ASIDE or role in _ROLES or "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
            return BESIDE, inside
        if "display:none" in (attributes.get("style") or "").lower().replace(" ", ""):
            return BESIDE, inside
        if name == "article":
            # An article inside an article is a reader's comment on it.
            return (BESIDE if inside else ARTICLE), True
        if name in ("html", "body"):
            return region, inside
        if name == "header" and not inside:
            return BESIDE, inside
        if name == "main" or role == "main":
            return min(region, MAIN), inside
        for key in ("class", "id"):
            if attributes.get(key):
                words = _words(attributes[key])
                if any(w in _BESIDE or (w == "header" and not inside) for w in words):
                    return BESIDE, inside
        return region, inside


def read_page(html: str | None) -> Page:
    """Tokens and blocks of a page; a null or empty one has none."""
    reader, at, skipped = _Reader(), 0, None
    html = html or ""
    while at < len(html):
        found = _TAG.search(html, at)
        reader.text(html[at : found.start() if found else len(html)])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            reader.end(name)
            continue
        reader.start(name, found[3])
        if name in _RAW:
            skipped = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = skipped.start() if skipped else len(html)
    while len(reader.stack) > 1:
        reader.close_top()
    reader.end_block()
    return reader.page
