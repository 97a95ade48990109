"""A lenient HTML reader: block elements of a page as a tree, each with its own text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">]++)*+>|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object audio video canvas head title datalist".split())
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
BLOCK = frozenset(
    "html body article main section nav aside header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 form fieldset legend label button select option textarea address details summary dialog menu center hr".split()
)
#: An opening tag ends the nearest open element of these names, unless one of the fences stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: A block ends an open paragraph, but not one outside of these.
FENCES = frozenset("td th table button object caption".split())
PARAGRAPH_ENDS = BLOCK - {"html", "body", "label", "button", "select", "option", "textarea", "legend", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}


class Node:
    __slots__ = ("name", "attributes", "parent", "text", "linked")

    def __init__(self, name: str, attributes: str, parent: int):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.text = self.linked = 0  # characters of its own text, and of those in links


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else "hidden": html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the first is the page itself; a parent stands before its children), and the
    page's text in order: (number of the innermost block, text). Texts of separate runs are separate blocks; line
    breaks are white space; what is never shown is left out. Time is linear in the page, however deep it is nested: the
    places of open elements are kept by name."""
    nodes = [Node("html", "", -1)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with the block it is in or is
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
    blocks = [0]  # places of blocks in the stack
    endless: set[str] = set()  # names without a further end tag
    parts: list[str] = []
    links, at, end = 0, 0, len(page)

    def flush() -> None:
        if parts:
            words = " ".join("".join(parts).split())
            parts.clear()
            if words:
                runs.append((stack[-1][1], words))
                nodes[stack[-1][1]].text += len(words)

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                nodes[stack[-1][1]].linked += len(raw.strip())

    def push(name: str, block: int) -> None:
        opened[name].append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, block))

    def innermost(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def close(k: int) -> None:
        nonlocal links
        flush()
        while len(stack) > k:
            name, _ = stack.pop()
            if name:
                opened[name].pop()
                links -= name == "a"
        while blocks[-1] >= len(stack):
            blocks.pop()

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            text(m["data"] or "")
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                parts.append(" ")
                continue
            k = innermost((name,))
            if k and name in BLOCK:
                close(k)
            elif k > blocks[-1]:  # an inline end tag closes inline elements alone, and leaves its place empty
                opened[name].pop()
                links -= name == "a"
                stack[k] = ("", stack[k][1])
            continue
        if name in UNSEEN and name != "head":
            if not m["rest"].endswith("/>"):
                stop = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                else:
                    endless.add(name)
                    at = end if name in RAW else at
            continue
        if name in ("html", "head", "body"):
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in VOID and name != "hr":
            continue
        if name in PARAGRAPH_ENDS:
            k = innermost(("p",))
            if k > innermost(FENCES):
                close(k)
        if name in ENDS:
            names, fences = ENDS[name]
            fence = innermost(fences)
            found = [places[bisect_right(places, fence)] for places in map(opened.get, names) if places and places[-1] > fence]
            if found:
                close(min(found))
        if name in BLOCK:
            flush()
            if name == "hr":
                continue
            nodes.append(Node(name, m["rest"], stack[-1][1]))
            push(name, len(nodes) - 1)
            if name == "textarea":
                stop = re.compile(r"</textarea\s*>", re.I).search(page, at)
                stop_at = stop.start() if stop else end
                text(page[at:stop_at])
                at = stop_at
        elif not m["rest"].endswith("/>"):
            push(name, stack[-1][1])
            links += name == "a"
    close(1)
    flush()
    return nodes, runs
