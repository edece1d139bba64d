"""Leaf blocks of a web page: its text between block elements, each with the path of elements around it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements that part text into blocks. fixed values
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe ins"
    " label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page. fixed values
UNREAD = frozenset("script style template noscript title textarea svg math head".split())
#: Elements without content. fixed values
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
#: An element that opens closes these where they are open, up to one that holds it. fixed values
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Elements in a p that leave it open. fixed values
IN_P = frozenset("button ins object iframe label select option optgroup".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(tag: str) -> tuple[str, ...]:
    """Words of the names that a tag bears."""
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return ()
    out = []
    for name, *values in ATTRIBUTE.findall(tag):
        name, value = name.lower(), "".join(values)
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        elif name == "hidden":
            out.append("hidden")
        else:
            out += [p.lower() for p in PART.findall(value)[:12]]
    return tuple(out)


def leaves(page: str) -> Iterator[tuple[tuple[tuple[str, tuple[str, ...]], ...], str, int]]:
    """(path, text, characters inside links) of each block with text, in page order.

    A path has (element, words of its class, id, role and itemprop) from the outside in. Character references are decoded, white
    space is one space each, what is at the ends goes. Broken nesting is taken as browsers do: an end tag closes what is
    open inside its element, one without a begin is passed over, and a p ends where the next block begins.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, in_link, at = 0, False, 0

    def block():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts, inside, links = [], links, 0
            if text:
                yield tuple(stack), text, inside

    while True:
        found = MARKUP.search(page, at)
        if found is None or found.start() > at:
            piece = page[at : found.start() if found else len(page)]
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        if found is None:
            break
        tag, at = found.group(), found.end()
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                yield from block()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name in UNREAD:
            if name == "head":
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            parts.append("\n")
        elif name in BLOCKS:
            yield from block()
            in_link = False
            if name not in IN_P and any(n == "p" for n, _ in stack):
                del stack[max(i for i, (n, _) in enumerate(stack) if n == "p") :]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in HOLDS.get(name, ()) or name not in CLOSES:
                    break
                if stack[i][0] in CLOSES[name]:
                    del stack[i:]
                    break
            if name not in EMPTY and not tag.endswith("/>"):
                stack.append((name, _marks(tag)))
    yield from block()
