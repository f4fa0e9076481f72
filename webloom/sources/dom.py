"""A small document tree for HTML and the selectors that extraction rules use."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: Callable[[Node], bool] = lambda _: False) -> str:
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif not skip(x):
                stack += reversed(x.children)
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for closed in CLOSES.get(tag, ()):
            node = self.at
            while node.parent is not None and node.tag not in ("table", "ul", "ol", "div", "article", "section", "body", closed):
                node = node.parent
            if node.tag == closed:
                self.at = node.parent
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self.at
        self.handle_starttag(tag, attrs)
        if tag in ("path", "circle", "rect", "use", "line", "polygon"):
            self.at = at

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def free(root: Node) -> None:
    """Takes a tree that has been read apart, so that its memory is free at once: nodes and their parents hold each other, and would wait for the collector."""
    for node in list(root.walk()):
        node.parent = None


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = next((v or "" for k, v in attrs if k == "href"), None)
            if href is not None:
                self.found.append(href)


def hrefs(html: str) -> list[str]:
    """The href of every anchor that has one, in document order, without a tree."""
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.found


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]*)))?\s*\]""")
Test = Callable[[Node], bool]


def _simple(text: str) -> Test:
    tests: list[Test] = []
    for tag, cls, ident, name, op, *values in _SIMPLE.findall(text):
        value = "".join(values)
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif cls:
            tests.append(lambda n, c=cls: c in n.attrs.get("class", "").split())
        elif ident:
            tests.append(lambda n, i=ident: n.attrs.get("id") == i)
        elif name:
            how = {
                "": lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v != "" and v in a, "^=": lambda a, v: v != "" and a.startswith(v),
                "$=": lambda a, v: v != "" and a.endswith(v), "~=": lambda a, v: v in a.split(),
            }[op]
            tests.append(lambda n, k=name.lower(), v=value, f=how: k in n.attrs and f(n.attrs[k], v))
    return lambda n: all(t(n) for t in tests)


_COMPILED: dict[str, list[list[Test]]] = {}


def _compiled(selector: str) -> list[list[Test]]:
    """Alternatives of chains of tests, outermost element first: type, .class, #id, [attr], [attr op 'v'], lists and descendants."""
    if selector not in _COMPILED:
        _COMPILED[selector] = [[_simple(x) for x in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part)] for part in re.split(r",(?![^\[]*\])", selector)]
    return _COMPILED[selector]


def _matches(node: Node, chain: list[Test]) -> bool:
    if not chain or not chain[-1](node):
        return False
    rest, up = chain[:-1], node.parent
    while rest and up is not None:
        if rest[-1](up):
            rest = rest[:-1]
        up = up.parent
    return not rest


def select(root: Node, selector: str) -> Iterator[Node]:
    chains = _compiled(selector)
    return (n for n in root.walk() if any(_matches(n, c) for c in chains))


def first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)
