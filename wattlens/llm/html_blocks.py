"""Pages as sequences of leaf blocks: text between block-level borders, with its tag path."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Fixed values of HTML: elements without end tag, elements whose content is no markup, elements with markup that is no text of
#: the page, elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
HIDDEN = frozenset("template noscript iframe object svg math canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_SIBLING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CONTAINERS = frozenset("html body div article section main nav aside header footer form td th li table blockquote figure ul ol dl dd fieldset details".split())


@dataclass
class Block:
    path: tuple[str, ...]  # from the outermost element: tag, then .name for each part of its class, id and role
    text: str
    linked: int  # code points inside links


def _label(tag: str, attributes: str) -> str:
    names = []
    if attributes and "=" in attributes:
        for _, a, b, c in ATTRIBUTE.findall(attributes):
            names += re.split(r"[\s_-]+", (a or b or c).lower())
    return ".".join([tag, *dict.fromkeys(n for n in names if n)])


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order. Unclosed and misnested tags are closed where a browser would:
    a paragraph by the next block, a list item by the next item, all by the end of the page.
    Comments, declarations and the content of scripts, styles and the like are no text. A hidden
    element without an end tag ends with the element around it."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = links = hidden = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, path
        if not raw or hidden:
            return
        if not parts:
            if raw.isspace():
                return
            path = tuple(label for tag, label in stack if tag not in INLINE)
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def pop_to(i: int) -> None:
        nonlocal links, hidden
        links -= sum(tag == "a" for tag, _ in stack[i:])
        hidden -= sum(tag in HIDDEN for tag, _ in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            if lt + 1 < end and (page[lt + 1].isalpha() or page[lt + 1] == "/"):  # a tag that is not closed as it should be
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                add("<")
                at = lt + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag == "br":
            if parts and not hidden:
                parts.append(" ")
            continue
        border, inside = tag not in INLINE and tag not in VOID and tag not in RAW and tag not in HIDDEN or tag == "hr", hidden
        if border and not hidden:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][0] in CONTAINERS:
                    break
            if border and inside and not hidden:
                flush()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end if stop is None else stop.end()
            continue
        if tag in VOID or tag in HIDDEN and attributes.endswith("/"):
            continue
        if tag in HIDDEN:
            hidden += 1
            stack.append((tag, tag))
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in CONTAINERS or stack[i][0] in HIDDEN:
                    break
        if tag in CLOSED_BY_SIBLING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or tag in ("dt", "dd", "td", "th") and stack[i][0] in ("dt", "dd", "td", "th"):
                    pop_to(i)
                    break
                if stack[i][0] in CLOSED_BY_SIBLING[tag] or stack[i][0] in HIDDEN:
                    break
        if tag == "a":
            links += 1
        stack.append((tag, _label(tag, attributes)))
    flush()
    return out
