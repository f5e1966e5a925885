"""One HTML page to element records: a tolerant tree walk for use inside an Arrow-batched UDF."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b big cite code em font i label mark q s small span strike strong sub sup tt u".split())
BLOCK = frozenset(
    "address article aside blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "li main nav ol p pre section table ul".split()
)
# Start tag -> open tags that it ends, looking up to the nearest of the stop tags.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
SILENT = frozenset({"script", "style", "template"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WANTED = HEADINGS | {"a", "span", "div", "p", "li", "article", "section"}
MAIN = frozenset({"article", "main"})
OPEN_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


class _Node:
    __slots__ = ("tag", "ord", "attrs", "pieces", "first_heading", "ancestors", "in_main")

    def __init__(self, tag, ord_, attrs, ancestors, in_main):
        self.tag, self.ord, self.attrs = tag, ord_, attrs
        self.pieces: list[str] = []
        self.first_heading: _Node | None = None
        self.ancestors, self.in_main = ancestors, in_main


def _marks(attrs: dict) -> str:
    """Lower-cased class and id, apart from each other so no fragment can span both."""
    return f"{' '.join((attrs.get('class') or '').split())}\n{attrs.get('id') or ''}".lower()


class _Walker(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.found: list[_Node] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_paragraph()
        if tag in ENDS:
            ends, stops = ENDS[tag]
            self._end_until(ends, stops)
        node = _Node(
            tag,
            self.count,
            dict(attrs),
            self.open[:-4:-1],
            any(n.tag in MAIN for n in self.open),
        )
        self.count += 1
        if tag in WANTED:
            self.found.append(node)
        if tag in HEADINGS:
            for outer in self.open:
                if outer.first_heading is None:
                    outer.first_heading = node
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if not piece or (self.open and self.open[-1].tag in SILENT):
            return
        for node in self.open:
            if node.tag in WANTED:
                node.pieces.append(piece)

    def _end_paragraph(self):
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth].tag
            if tag == "p":
                del self.open[depth:]
                return
            if tag not in INLINE:
                return

    def _end_until(self, ends, stops):
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth].tag
            if tag in stops:
                return
            if tag in ends:
                del self.open[depth:]
                return


def closed_references(html: str) -> str:
    """The page with every ``&`` escaped that starts no known reference with a semicolon."""
    return OPEN_REFERENCE.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", html)


def elements(html: str, closed: bool = False) -> list[dict]:
    """Records of the wanted tags in document order. As browsers do, ``&amp`` is read as ``&``; with
    ``closed``, only ``&amp;`` is.

    ``text`` is the joined text below the tag; for article and section it is the first heading's.
    ``main_line`` marks paragraphs of the main body: those inside article or main, or all of them
    on a page that has neither.
    """
    walker = _Walker()
    walker.feed(closed_references(html or "") if closed else html or "")
    walker.close()
    has_main = any(n.in_main or n.tag in MAIN for n in walker.found)
    out = []
    for node in walker.found:
        source = node.first_heading if node.tag in ("article", "section") else node
        text = " ".join(source.pieces) if source is not None else None
        out.append(
            {
                "ord": node.ord,
                "tag": node.tag,
                "text": text,
                "own_attrs": _marks(node.attrs),
                "has_href": "href" in node.attrs,
                "main_line": node.tag == "p" and (node.in_main or not has_main),
                "ancestors": [{"tag": n.tag, "attrs": _marks(n.attrs)} for n in node.ancestors],
            }
        )
    return out
