"""Small element-tree helper for pages whose nesting regular expressions
cannot follow. Called per page inside Arrow batches, and only for the pages
that :mod:`pageproof.operators.html` flags; all others stay on the JVM.

Inline elements end with their block, so an unclosed ``<b>`` covers the rest
of its paragraph and no more.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pageproof.functions.text import WS

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
INLINE = set("a abbr b bdi bdo cite code dfn em font i kbd label mark q s samp small span strong sub sup u var".split())
SIBLING_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
SAME_AS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# fixed values: containers of the main content, in order of preference
SCOPES = ("article", "main", ".post-content", ".entry-content", ".blog-content", ".article-content", "#content")
CONTENT_CLASSES = ("content", "answer", "body", "panel")
HEADING_CLASSES = ("trigger", "heading", "header", "title")

_ws = re.compile(WS + "+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "index", "end")

    def __init__(self, tag, attrs, parent, index):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.parent, self.index, self.end = parent, index, index

    def cls(self):
        return self.attrs.get("class") or ""

    def holds(self, other):
        return self.index < other.index <= self.end

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class Tree(HTMLParser):
    """Nodes in document order; a subtree is the slice index..end."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []
        self._push("#root", {})
        self.feed(html)
        self.close()
        while self.open:
            self._pop()

    def _push(self, tag, attrs):
        node = Node(tag, attrs, self.open[-1] if self.open else None, len(self.nodes))
        self.nodes.append(node)
        if node.parent is not None:
            node.parent.parts.append(node)
        self.open.append(node)

    def _pop(self):
        node = self.open.pop()
        node.end = len(self.nodes) - 1

    def _pop_through(self, tags, stop=()):
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._pop_through({"p"}, stop={"table", "td", "th", "button", "div", "section", "article", "li"})
        if tag in SIBLING_ENDS:
            self._pop_through(SAME_AS.get(tag, {tag}), stop=SIBLING_ENDS[tag])
        if tag == "a":
            self._pop_through({"a"}, stop={"table", "td", "th"})
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self._push(tag, first)
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or not any(n.tag == tag for n in self.open):
            return
        if tag in INLINE:  # an inline end tag never closes a block
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    break
                if self.open[k].tag not in INLINE:
                    return
        self._pop_through({tag})

    def handle_data(self, data):
        self.open[-1].parts.append(data)

    def text(self, node, without=None) -> str:
        out, stack = [], [node]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part is not without:
                stack.extend(reversed(part.parts))
        return _ws.sub(" ", "".join(out)).strip(" ")

    def below(self, node):
        return self.nodes[node.index + 1 : node.end + 1]


def _matches(node, selector):
    if selector[0] == ".":
        return selector[1:] in node.cls().split()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    return node.tag == selector


def page_parts(html: str) -> dict:
    """Blocks, links and bold phrases with their scope flag."""
    tree = Tree(html)
    scope, roots = "body", None
    for selector in SCOPES:
        found = [n for n in tree.nodes if _matches(n, selector)]
        if found:
            scope, roots = selector, found
            break
    inside = [roots is None] * len(tree.nodes)
    for root in roots or ():
        inside[root.index + 1 : root.end + 1] = [True] * (root.end - root.index)
    blocks, anchors, bolds = [], [], []
    for n in tree.nodes:
        flag = inside[n.index]
        level = n.tag[1] if re.fullmatch("h[1-6]", n.tag) else None
        if level is None and n.attrs.get("role") == "heading" and n.attrs.get("aria-level") in ("2", "3", "4"):
            level = n.attrs["aria-level"]
        if level is not None:
            blocks.append({"kind": "h" + level, "text": tree.text(n), "in_scope": flag})
        if n.tag in ("p", "li", "blockquote", "figcaption"):
            blocks.append({"kind": n.tag, "text": tree.text(n), "in_scope": flag})
        elif n.tag == "a" and "href" in n.attrs:
            anchors.append({"text": tree.text(n), "href": n.attrs["href"], "in_scope": flag})
        elif n.tag in ("b", "strong"):
            bolds.append({"text": tree.text(n), "in_scope": flag})
    return {"scope": scope, "blocks": blocks, "anchors": anchors, "bolds": bolds}


def faq_items(html: str) -> list:
    """Question/answer pairs of the markup strategies, numbered by preference:
    2 class-named accordions, 3 tab widgets, 4 ARIA triggers, 5 details."""
    tree = Tree(html)
    has = lambda n, names: any(c in n.cls() for c in names)
    out: list = []

    def add(strategy, question, answer):
        if question and answer:
            out.append({"strategy": strategy, "question": question, "answer": answer})

    heads = [
        n for n in tree.nodes if has(n, HEADING_CLASSES) and any("accordion" in a.cls() for a in n.ancestors())
    ]
    leaves = [h for h, nxt in zip(heads, heads[1:] + [None]) if nxt is None or not h.holds(nxt)]
    for head in leaves:
        answer = ""
        for depth, around in enumerate(head.ancestors()):
            if depth == 5 or answer:
                break
            for n in tree.below(around):
                if has(n, CONTENT_CLASSES) and n is not head and not n.holds(head):
                    answer = tree.text(n)
                    if answer:
                        break
        add(2, tree.text(head), answer)

    by_id: dict = {}
    for n in tree.nodes:
        if n.attrs.get("id"):
            by_id.setdefault(n.attrs["id"], n)
    for n in tree.nodes:
        classes = n.cls().split()
        if "elementor-tab-title" in classes:
            items = [a for a in (n, *n.ancestors()) if "elementor-accordion-item" in a.cls().split()]
            box = items[0] if items else n.parent
            panel = next((x for x in tree.below(box) if "elementor-tab-content" in x.cls().split()), None)
            add(3, tree.text(n), tree.text(panel) if panel else "")
        if "aria-expanded" in n.attrs and "aria-controls" in n.attrs:
            panel = by_id.get(n.attrs["aria-controls"])
            add(4, tree.text(n), tree.text(panel) if panel else "")
        if n.tag == "details":
            head = next((x for x in tree.below(n) if x.tag == "summary"), None)
            if head:
                add(5, tree.text(head), tree.text(n, without=head))
    return out
