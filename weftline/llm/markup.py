"""HTML cut into flat text blocks.

A block is the text between two block-level tags, with its white space closed up and its
character references decoded. With it go what a classifier needs: its words and how many of
them are links, the same of its neighbours, and in what kinds of containers it lies.
Markup may be broken in any way; see ``cut_blocks``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Elements by what they do to the text around them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their text is never part of the page; the first four run to the end where nothing closes them.
DROPPED_TAGS = frozenset(
    "script style xmp noframes title textarea iframe noembed noscript template svg canvas select "
    "datalist button object audio video applet".split()
)
TO_THE_END = frozenset("script style xmp noframes".split())
# What an opening tag closes, and the tags beyond which it does not look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "option": (("option",), ("select",)),
}

# Names that say what a container is for.
CONTENT_TAGS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("nav aside footer form dialog menu search".split())
CONTENT_ROLES = frozenset(("main", "article"))
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split()
)
CONTENT_WORDS = frozenset("article content main post entry story".split())
READER_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
HEAD_WORDS = frozenset("header masthead banner topbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended recommendations teaser cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "search form share sharing social pagination pager paging toolbar copyright legal disclaimer skip sitemap".split()
)
# Words after these do not say what the container itself is.
OTHER_PREFIXES = frozenset("has with without no is tag category format type".split())
PHRASES = re.compile(
    r"©|\(c\) \d{4}|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign (?:up|in)|log ?in\b"
    r"|newsletter|advertisement|sponsored|enable javascript",
    re.IGNORECASE,
)

NONE, CONTENT, ASIDE = 0, 1, 2
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_content", "in_aside", "in_named_content", "asides_inside", "asides_around", "reader_comment", "form",
    "heading", "paragraph", "item", "page_has_content", "page_has_named_content", "phrase",
    "outermost_content",
)

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z!?/][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HEADING = re.compile("h[1-6]")


@dataclass(frozen=True)
class Place:
    """What the containers around a text say, from the outermost in."""

    kind: int = NONE
    named: bool = False  # the nearest content container is an element or role for content
    inside: int = 0  # containers of other things within the nearest content container
    around: int = 0  # and around it
    reader: bool = False
    form: bool = False

    def within(self, kind: int, named: bool, reader: bool, form: bool) -> Place:
        reader, form = self.reader or reader, self.form or form
        if kind == CONTENT:
            return Place(CONTENT, named, 0, self.around + self.inside, reader, form)
        if kind == ASIDE:
            return Place(ASIDE, self.named, self.inside + 1, self.around, reader, form)
        return Place(self.kind, self.named, self.inside, self.around, reader, form)


@lru_cache(maxsize=4096)
def container(name: str, attributes: str, in_content: bool) -> tuple[int, bool, bool, bool]:
    """Kind of a container by its name and attributes, whether it is an element or role for
    content, whether it holds readers' comments, and whether it is a form."""
    given = {key.lower(): value.strip("\"'").lower() for key, value in _ATTRIBUTE.findall(attributes)}
    role = given.get("role", "")
    named = name in CONTENT_TAGS or role in CONTENT_ROLES
    form = name == "form" or role == "form"
    if name in ("html", "body"):
        return NONE, False, False, form
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", ""))
    aside = bool(name in ASIDE_TAGS or role in ASIDE_ROLES or hidden or (name == "header" and not in_content))
    content = reader = False
    for word in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = re.findall("[a-z]+", word)
        if not parts or (parts[0] in OTHER_PREFIXES and len(parts) > 1):
            continue
        reader |= not READER_WORDS.isdisjoint(parts)
        ours = not CONTENT_WORDS.isdisjoint(parts)
        aside |= not ASIDE_WORDS.isdisjoint(parts)
        aside |= not HEAD_WORDS.isdisjoint(parts) and not ours and not in_content
        content |= ours
    if reader or aside:
        return ASIDE, False, reader, form
    return CONTENT if named or content else NONE, named, False, form


def cut_blocks(html: str) -> list[tuple[str, list[float]]]:
    """The text blocks of a page in order, with their features (see ``FEATURES``).

    Tags are read as browsers do: quotes count after an equals sign only, a comment, script
    or style that nothing closes runs to the end, and so does a tag; ``<`` before anything
    but a letter, ``/``, ``!`` or ``?`` is text. Elements may be left open or closed twice:
    a closing tag closes the nearest open element of its name with all within it, paragraphs
    end where a block begins, items and cells where the next begins, and a link ends with
    the element that it began in. Line breaks are white space. Unknown tags are inline.
    """
    found: list[tuple[str, Place, str, int, int]] = []  # text, place, element, words, of them in links
    pieces: list[str] = []
    linked = 0
    link_depth: int | None = None
    outside = Place()
    stack: list[tuple[str, Place]] = []

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link_depth is not None:
            linked += len(text.split())

    def end_block() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                name, place = stack[-1] if stack else ("", outside)
                found.append((" ".join(words), place, name, len(words), min(linked, len(words))))
            pieces.clear()
        linked = 0

    def close_from(at: int) -> None:
        nonlocal link_depth
        del stack[at:]
        if link_depth is not None and at < link_depth:
            link_depth = None

    at = 0
    while at < len(html):
        tag = _TOKEN.search(html, at)
        if tag is None:
            say(html[at:])
            break
        if tag.start() > at:
            say(html[at : tag.start()])
        at = tag.end()
        if name := tag["open"]:
            name, attributes = name.lower(), tag["attributes"]
            if name in DROPPED_TAGS:
                end = re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                if end or name in TO_THE_END:
                    at = end.end() if end else len(html)
            elif name == "a":
                link_depth = len(stack)
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCK_TAGS:
                end_block()
                if stack and stack[-1][0] == "p":
                    close_from(len(stack) - 1)
                names, beyond = CLOSES.get(name, ((), ()))
                for k in range(len(stack) - 1, -1, -1) if names else ():
                    if stack[k][0] in names:
                        close_from(k)
                    elif stack[k][0] not in beyond:
                        continue
                    break
                if name not in VOID_TAGS:
                    above = stack[-1][1] if stack else outside
                    in_content = above.kind == CONTENT
                    stack.append((name, above.within(*container(name, attributes, in_content))))
        elif name := tag["close"]:
            name = name.lower()
            if name == "a":
                link_depth = None
            elif name in BLOCK_TAGS:
                end_block()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close_from(k)
                        break
    end_block()
    return _described(found)


def _described(found: list[tuple[str, Place, str, int, int]]) -> list[tuple[str, list[float]]]:
    content = [place for _, place, *_ in found if place.kind == CONTENT and not place.reader]
    clean = [place for place in content if not place.around]
    named = any(place.named for place in clean)
    outermost = min((place.around for place in content), default=0)
    sizes = [(0.0, 0.0), *((float(words), linked / words) for *_, words, linked in found), (0.0, 0.0)]
    return [
        (
            text,
            [
                *sizes[k + 1], *sizes[k], *sizes[k + 2],
                float(place.kind == CONTENT), float(place.kind == ASIDE), float(place.kind == CONTENT and place.named),
                float(place.inside), float(place.around), float(place.reader), float(place.form),
                float(_HEADING.fullmatch(name) is not None), float(name == "p"), float(name in ("li", "dt", "dd", "td", "th")),
                float(bool(clean)), float(named), float(PHRASES.search(text) is not None),
                float(place.kind == CONTENT and not place.reader and place.around == outermost),
            ],
        )
        for k, (text, place, name, *_) in enumerate(found)
    ]
