"""A tolerant reader of HTML: block elements as a tree, and the text that stands directly in each of them.

Elements that are not closed end where HTML ends them (a paragraph at the next block, an item at the next item, everything at
the end of the page, a head at the first thing that cannot stand in one); end tags without a start are passed over. Inline elements belong to the block around them. Scripts,
styles, heads, templates, comments and other markup never give text; a quoted > does not end a tag. Raw elements go by their whole name
(<svg-icon> is no <svg>), and a self-closed svg or math is empty. A quote that is never closed counts as a letter; so do all quotes after a tag
whose end would lie beyond the page. A tag that the page ends in gives no text.

The page is read in one forward pass: every search either ends what it looks at or finds that the rest of the page has no such end,
which is kept in mind, so broken pages take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# fixed values: HTML's element names
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "math", "title", "textarea", "object")
#: What a head can hold; any other start tag, and text, ends it.
HEAD = frozenset(("base", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture")
)
#: An element that such a start tag ends if it is open and no other block stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "body": ("head",)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Token:
    """Markup from start to end. kind: start, end, raw (with all that it holds) or other (comments, declarations)."""

    kind: str
    start: int
    end: int
    name: str = ""
    attrs: str = ""


def tokens(html: str) -> Iterator[Token]:
    last = {c: html.rfind(c) for c in ">\"'"}
    quoted, at = True, html.find("<")

    def tag_end(p: int) -> int:
        """Place of the > that ends a tag whose attributes start at p; there is a > somewhere after p."""
        nonlocal quoted
        plain = html.find(">", p)
        while quoted:
            m = _MARK.search(html, p)
            if m is None:
                quoted = False  # a quoted > was the last one
            elif m[0] == ">":
                return m.start()
            elif last[m[0]] > m.start():
                p = html.find(m[0], m.end()) + 1
            else:
                p = m.end()
        return plain

    while at >= 0:
        first = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield Token("other", at, end)
        elif first in ("!", "?"):
            end = html.find(">", at) + 1 if last[">"] > at else len(html)
            yield Token("other", at, end)
        elif m := _NAME.match(html, at + 1 + (first == "/")):
            if last[">"] < m.end():  # the page ends in a tag
                yield Token("other", at, len(html))
                return
            name, close = m[0].lower(), tag_end(m.end())
            attrs, end = html[m.end() : close], close + 1
            if first == "/":
                yield Token("end", at, end, name, attrs)
            elif name in _RAW_END and not (name in ("svg", "math") and attrs.endswith("/")):
                shut = _RAW_END[name].search(html, end)
                end = len(html) if shut is None or last[">"] < shut.end() else html.find(">", shut.end()) + 1
                yield Token("raw", at, end, name)
            elif name in _RAW_END:
                yield Token("raw", at, end, name)
            else:
                yield Token("start", at, end, name, attrs)
        else:
            end = at + 1  # a < that stands for itself
        at = html.find("<", end)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[str] = frozenset()
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters directly in it
    linked: int = 0  # of these, in links
    words: int = 0
    marks: int = 0  # punctuation


_NONE: frozenset[str] = frozenset()


def _attribute_tokens(attrs: str) -> frozenset[str]:
    if "=" not in attrs and "hidden" not in attrs:
        return _NONE
    out: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name == "hidden":
            out.add("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.add("hidden")
        else:
            out.update(_PART.findall(_CAMEL.sub(" ", value.strip("\"'")).lower()))
    return frozenset(out)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Blocks in page order (a root first), and (block, text) in page order: decoded, with single spaces, never empty."""
    nodes, out = [Node("#root", -1, 0)], []
    stack: list[tuple[str, int, dict[str, int]]] = [("#root", 0, {})]  # open blocks, each with its node and how many inline elements are open right in it
    opened: dict[str, int] = {}  # how many blocks of a name are open, so that no end tag is looked for in vain
    held: list[str] = []
    in_head = links = 0
    linked = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text and not in_head:
                node = nodes[stack[-1][1]]
                node.own += len(text)
                node.linked += min(linked, len(text))
                node.words += text.count(" ") + 1
                node.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count("。") + text.count("、")
                out.append((stack[-1][1], text))
            held = []
        linked = 0

    def close(k: int) -> None:
        """End the open elements from place k of the stack."""
        nonlocal in_head, links
        flush()
        for tag, _, inside in stack[k:]:
            opened[tag] -= 1
            in_head -= tag == "head"
            links -= inside.get("a", 0)
        del stack[k:]

    def end_head() -> None:
        if in_head and stack[-1][0] == "head":
            close(len(stack) - 1)

    def hold(text: str) -> None:
        if in_head and text.strip(" \t\n\f\r"):
            end_head()
        held.append(text)

    at = 0
    for token in tokens(html):
        if token.start > at:
            hold(html[at : token.start])
            if links:
                linked += token.start - at
        at, tag = token.end, token.name
        if token.kind in ("raw", "other"):
            if token.kind == "raw":
                if tag not in HEAD:
                    end_head()
                held.append(" ")
            continue
        if token.kind == "start" and tag not in HEAD:
            end_head()
        if tag in VOID:
            if tag not in ("wbr", "img", "input"):
                held.append(" ")
            continue
        inside = stack[-1][2]
        if tag in INLINE:
            if token.kind == "end":
                if inside.get(tag):
                    inside[tag] -= 1
                    links -= tag == "a"
            elif not token.attrs.endswith("/"):
                inside[tag] = inside.get(tag, 0) + 1
                links += tag == "a"
            continue
        if token.kind == "end":
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        flush()
        ends = ENDS.get(tag, ())
        while (open_tag := stack[-1][0]) == "p" or open_tag in ends:
            close(len(stack) - 1)
            if open_tag == "p" and not ends:
                break
        if token.attrs.endswith("/"):
            continue
        parent = stack[-1][1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, _attribute_tokens(token.attrs)))
        nodes[parent].children.append(len(nodes) - 1)
        stack.append((tag, len(nodes) - 1, {}))
        opened[tag] = opened.get(tag, 0) + 1
        in_head += tag == "head"
    if at < len(html):
        hold(html[at:])
    flush()
    return nodes, out
