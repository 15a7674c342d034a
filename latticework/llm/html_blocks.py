"""Leaf blocks of an HTML page: their texts, tag paths and links, in page order.

Lenient like browsers where pages are broken: unclosed paragraphs and list
items end where the next begins, unmatched end tags are passed over, and
markup that is cut off ends with the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Elements that begin and end blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
#: Elements whose content is not text of the page.
RAW = frozenset("script style title textarea template iframe noembed noframes xmp svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value within the nearest block container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = frozenset("ul ol menu dl table select body article section main div".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    link_chars: int


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-cased class, id and role names."""
    if "=" not in attributes:
        return ()
    return tuple(w.lower() for _, a, b, c in NAMES.findall(attributes) for w in re.split(r"[\s_-]+", a or b or c) if w)


def parse(html: str) -> tuple[list[Block], str, list[str]]:
    """Blocks, title and link targets of a page."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, title, targets = 0, "", []
    in_link = 0
    at, end = 0, len(html)
    lower = None

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, tuple(stack), min(links, len(text))))
            parts.clear()
        links = 0

    while at < end:
        i = html.find("<", at)
        if i < 0:
            i = end
        if i > at:
            text = html[at:i]
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if in_link:
                links += len(text.strip())
            at = i
            continue
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = end if j < 0 else j + 3
            continue
        if html.startswith(("<!", "<?"), i):
            j = html.find(">", i)
            at = end if j < 0 else j + 1
            continue
        m = TAG.match(html, i) or LOOSE_TAG.match(html, i)
        if m is None:
            if html.startswith("</", i):  # a bogus comment
                j = html.find(">", i)
                at = end if j < 0 else j + 1
            else:
                parts.append("<")
                at = i + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "a":
                in_link = 0
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCK and any(t in BLOCK for t, _ in stack[k + 1 :]):
                        break  # an inline end tag does not close blocks
                    del stack[k:]
                    break
            if name in BLOCK:
                in_link = int(any(t == "a" for t, _ in stack))
            continue
        if name in RAW:
            if lower is None:
                lower = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda c: c[0].lower(), html)
            j = -1 if m[3].endswith("/") and name in ("svg", "math", "object", "canvas", "iframe", "template") else lower.find("</" + name, at)
            if m[3].endswith("/") and j < 0:
                continue
            if name == "title" and not title:
                title = " ".join(unescape(html[at : end if j < 0 else j]).split())
            k = html.find(">", j) if j >= 0 else -1
            at = end if k < 0 else k + 1
            continue
        if name in ("br", "wbr", "img", "input"):
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            if name in ENDS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ENDS[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in FENCES:
                        break
            in_link = int(any(t == "a" for t, _ in stack))
        if name == "a":
            in_link = 1
            if h := HREF.search(m[3]):
                targets.append(unescape(h[1] or h[2] or h[3] or ""))
        if name not in VOID and not (m[3].endswith("/") and name not in BLOCK):
            stack.append((name, names_of(m[3])))
    flush()
    return blocks, title, targets
