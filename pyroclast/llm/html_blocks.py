"""Leaf blocks of a web page: runs of text that no block element parts, with the names of what stands above them.

One pass over the page's tags keeps the stack of open elements.  End tags that pages leave
out are understood (a block element ends a paragraph, an item ends the one before), end
tags of nothing are passed over, and what is open at the end of the page ends there.
Above a block stand the tags and the words of class, id, role and itemprop of its
ancestors, each once, so deep nesting costs no more than its different names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Elements by kind.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never a block.
SILENT = frozenset("script style template noscript title textarea select datalist button svg iframe object canvas head audio video".split())
#: Of these, elements whose content isn't markup.
RAW = frozenset("script style title textarea iframe".split())
#: What an element of this name ends, up to one of the elements that bound it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    """Text with single spaces, how many of its characters are links, the names above it, and its own element."""

    text: str
    linked: int
    above: frozenset[str]
    tag: str


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = ["<" + tag]
    if attributes:
        for value in _NAMED.findall(attributes):
            found += [w.lower() for w in _WORD.findall(value)]
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks that have text, in order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_, above = Counter(), Counter()  # open tags; names above
    path: frozenset[str] | None = None
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    held: tuple[frozenset[str], str] = (frozenset(), "")

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len("".join(t.split())) for t, a in parts if a)
                out.append(Block(text, linked, *held))
            parts.clear()

    def pop() -> str:
        tag, names = stack.pop()
        open_[tag] -= 1
        for n in names:
            above[n] -= 1
            if not above[n]:
                del above[n]
        return tag

    def say(raw: str) -> None:
        nonlocal path, held
        if any(open_[t] for t in SILENT if t in open_):
            return
        if not parts:
            if not raw.strip():
                return
            path = frozenset(above) if path is None else path
            held = path, next((t for t, _ in reversed(stack) if t not in INLINE), "")
        parts.append((html.unescape(raw) if "&" in raw else raw, open_["a"] > 0))

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:  # a comment or a declaration
            continue
        tag = m[2].lower()
        block = tag not in INLINE
        between = block and (tag == "head" or tag not in SILENT)
        if tag == "br" and parts:
            parts.append((" ", False))
        if between:
            flush()
        if m[1]:
            if not open_[tag]:
                continue
            path = None
            if block:
                while pop() != tag:
                    pass
            else:  # an inline end tag ends no block
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if all(t in INLINE or t == "p" for t, _ in stack[i + 1 :]):
                    while pop() != tag:
                        pass
            continue
        if between and open_["p"]:
            i = len(stack) - 1
            while stack[i][0] in INLINE:
                i -= 1
            if stack[i][0] == "p":
                while pop() != "p":
                    pass
        if tag in ENDS:
            ended, bound = ENDS[tag]
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in ended and stack[i][0] not in bound and (stack[i][0] in INLINE or stack[i][0] in ("p", "tbody", "thead", "tfoot")):
                i -= 1
            while i >= 0 and stack[i][0] in ended:
                while len(stack) > i:
                    pop()
                i -= 1
        path = None
        if tag in VOID:
            continue
        if m[3].endswith("/") and tag == "svg":
            continue
        names = _names(tag, m[3])
        stack.append((tag, names))
        open_[tag] += 1
        above.update(names)
        if tag in RAW:
            end = _CLOSE[tag].search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        say(page[at:])
    flush()
    return out
