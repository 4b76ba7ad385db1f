"""HTML pages as trees: elements with their tag as type, attributes as properties, text as leaves."""

from __future__ import annotations

from html.parser import HTMLParser

from treeloom.tree.nodes import Node

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document", dsl_type="document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        while len(self.open) > 1 and self.open[-1].node_type in closes:
            self.open.pop()
        props = {k: v or "" for k, v in attrs}
        n = self.open[-1].add(Node(tag, dsl_type=tag, label=tag, name=tag, props=props, start_line=self.getpos()[0]), "children", "Collection")
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].node_type == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text:
            leaf = Node("text", dsl_type="text", label=text, value=text, start_line=self.getpos()[0])
            leaf.own_tokens = text.split()
            self.open[-1].add(leaf, "children", "Collection")


def parse_html(source: str | None) -> Node:
    b = _Builder()
    b.feed(source or "")
    b.close()
    return b.root
