"""A tolerant HTML tree, numbered in document order.

The tokenizer is the standard library's.  The tree follows the HTML standard where pages commonly
depend on it: void elements, end tags left out (paragraphs, list items, table parts, options), end
tags without a start, and elements that the end of the page leaves open.  It does not do foster
parenting or formatting reconstruction, and reads the children of ``noscript`` as elements.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
#: Start tags that end an open sibling: what they end, and where the search stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset(("table", "td", "th", "caption", "button", "object", "html"))
CONTEXT = ("class", "id", "data-testid", "role", "aria-label", "aria-busy", "aria-hidden")


class Node:
    """An element.  The text under it is ``pieces[first:until]``: the pieces of a page are one list."""

    __slots__ = ("nid", "parent", "last", "depth", "tag", "attrs", "texts", "pieces", "first", "until")

    def __init__(self, nid: int, parent: Node | None, tag: str, attrs: dict[str, str], pieces: list[str]) -> None:
        self.nid, self.parent, self.tag, self.attrs = nid, parent, tag, attrs
        self.depth, self.last = (parent.depth + 1 if parent else 0), nid
        self.texts: list[str] = []
        self.pieces, self.first, self.until = pieces, len(pieces), len(pieces)

    def ancestors(self, limit: int = 40) -> list[Node]:
        out, at = [], self.parent
        while at is not None and len(out) < limit:
            out.append(at)
            at = at.parent
        return out

    def words(self) -> str:
        return " ".join(f"{k}:{self.attrs[k]}" for k in CONTEXT if self.attrs.get(k))


class Builder(HTMLParser):
    """Feeds the tokens of a page into a list of nodes; ``nodes[0]`` is the document itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.nodes = [Node(0, None, "", {}, self.pieces)]
        self.open = [self.nodes[0]]

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node.last, node.until = len(self.nodes) - 1, len(self.pieces)

    def _end_siblings(self, names: set[str], stops: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in stops:
                break
            if tag in names:
                self._close(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body") and any(n.tag == tag for n in self.open):
            return
        if tag in CLOSES_P:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == "p":
                    self._close(depth)
                    break
                if self.open[depth].tag in SCOPES:
                    break
        if tag in SIBLINGS:
            self._end_siblings(*SIBLINGS[tag])
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name.lower(), value or "")
        node = Node(len(self.nodes), self.open[-1], tag, first, self.pieces)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._close(depth)
                return
            if self.open[depth].tag in ("td", "th") and tag not in ("tr", "table", "thead", "tbody", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].texts.append(data)
        self.pieces.append(data)

    def parse_html_declaration(self, i: int) -> int:
        # ``<![...`` is a comment to a browser; the standard library gives up on words it does not know.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def parse(page: str) -> list[Node]:
    builder = Builder()
    builder.feed(page)
    builder.close()
    builder._close(0)
    return builder.nodes


def collapsed_text(node: Node, most: int | None = None) -> str:
    """All text under a node with white space collapsed; its first ``most`` characters if that is given."""
    out, size = [], 0
    for at in range(node.first, node.until):
        out.append(piece := node.pieces[at])
        # Collapsing leaves at least these, so that enough is read however much white space there is.
        size += sum(map(len, piece.split()))
        if most is not None and size > most:
            break
    return " ".join("".join(out).split())[:most]


def deep_text(node: Node, most: int | None = None, between: str = "") -> str:
    """All text under a node in document order, up to about ``most`` characters."""
    out, size = [], 0
    for at in range(node.first, node.until):
        out.append(node.pieces[at])
        size += len(out[-1])
        if most is not None and size > most:
            break
    return between.join(out)
