"""A small tolerant HTML tree: elements with tag, id, class and visible text, in document order."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where another of the group begins, up to the element that holds them.
_SAME = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "option": ("option", {"select"}), "tbody": ("tr td th tbody thead", {"table"}), "thead": ("tr td th tbody thead", {"table"})}
#: An open paragraph ends where one of these begins.
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "header", "footer", "nav", "main", "form", "pre", "hr", "blockquote", "address", "fieldset"}
INLINE = {"a", "b", "i", "em", "strong", "span", "small", "sub", "sup", "u", "font", "abbr", "cite", "code", "q", "label"}


class Node:
    __slots__ = ("tag", "id", "parent", "children", "text", "chars", "link_chars", "tags", "link_tags", "hidden", "order", "link", "links", "last", "words", "lead")

    def __init__(self, tag: str, parent: "Node | None", order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.id: str | None = None
        self.children: list[Node] = []
        self.text: list[str] = []  # visible text of the element and of its inline elements without an id
        self.hidden = bool(parent and parent.hidden)
        self.link: Node | None = self if tag == "a" else parent.link if parent else None  # the link it stands in
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        # Of the text: its links, the last of them, letters and digits outside links so far and before the last link.
        self.links = self.words = self.lead = 0
        self.last: Node | None = None


def parse(page: str) -> list[Node]:
    """The elements of a page in document order, the root first. Comments, scripts and the like leave nothing. Missing
    end tags are made up as browsers do for lists, tables and paragraphs; other stray end tags are left out."""
    root = Node("#root", None, 0)
    nodes, open_ = [root], [root]
    known: set[str] = set()  # tags that were opened: an end tag without one is passed over at once
    skip = None
    for m in _TOKEN.finditer(page):
        end, tag, attrs, text = m.groups()
        if skip:
            if end and tag.lower() == skip:
                skip = None
            continue
        if text is not None:
            if not text.isspace():
                here = open_[-1]
                shown = html.unescape(text) if "&" in text else text
                if not here.hidden:
                    n = len("".join(shown.split()))
                    here.chars += n
                    if here.link:
                        here.link_chars += n
                    at = here
                    while at.id is None and at.tag in INLINE and at.parent:
                        at = at.parent
                    at.text.append(shown)
                    if here.link is None:
                        at.words += sum(map(str.isalnum, shown))
                    elif at.last is not here.link:
                        at.last, at.lead, at.links = here.link, at.words, at.links + 1
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if tag not in known:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if open_[k].tag in ("table", "td") and tag in ("li", "p", "div", "ul", "ol"):
                    break
            continue
        if tag in _RAW:
            skip = tag
            continue
        if tag in _SAME:
            group, stop = _SAME[tag]
            group = group.split()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in stop:
                    break
                if open_[k].tag in group:
                    del open_[k:]
        if tag in _ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    del open_[k:]
                    break
                if open_[k].tag not in INLINE:
                    break
        node = Node(tag, open_[-1], len(nodes))
        if attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name = name.lower()
                if name == "id":
                    node.id = html.unescape(a or b or c)
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I):
                    node.hidden = True
        open_[-1].children.append(node)
        nodes.append(node)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            open_.append(node)
            known.add(tag)
    for node in reversed(nodes[1:]):
        up = node.parent
        up.chars += node.chars
        up.link_chars += node.link_chars
        up.tags += node.tags + 1
        up.link_tags += node.link_tags + (node.tag == "a")
    return nodes
