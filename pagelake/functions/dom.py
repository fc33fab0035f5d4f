"""A small HTML tree: tolerant parsing with implied elements, and text helpers. Pure Python, run inside Arrow stages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = ("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp")
ESCAPABLE_TEXT = ("title", "textarea")
HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
#: Elements whose start closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: For a start tag: the open elements that it closes, and those beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th"}),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template"})
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


class Node:
    """An element (tag set) or a text (tag empty, text set)."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str = "", attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def attr(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag)

    def text_content(self) -> str:
        return "".join(n.text for n in self.walk() if not n.tag)

    def find(self, test) -> Node | None:
        return next((n for n in self.elements() if test(n)), None)


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = RAW_TEXT
    RCDATA_CONTENT_ELEMENTS = ESCAPABLE_TEXT

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = Node("#document")
        self.html = self.document.add(Node("html"))
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.html]

    def _enter_head(self) -> None:
        if self.head is None:
            self.head = self.html.add(Node("head"))
            self.open = [self.html, self.head]

    def _enter_body(self) -> None:
        if self.body is None:
            self._enter_head()
            self.body = self.html.add(Node("body"))
            self.open = [self.html, self.body]

    def _close_until(self, names: set[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return self._close_until(names, stops)
            if self.open[k].tag in stops:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            if tag == "html":
                target = self.html
            elif tag == "head":
                self._enter_head()
                target = self.head
            else:
                self._enter_body()
                target = self.body
            for k, v in found.items():
                target.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                self._enter_head()
            else:
                self._enter_body()
        if tag in CLOSES_P:
            self._close_until({"p"}, SCOPES)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in CLOSES:
            self._close_until(*CLOSES[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self.open.append(self.open[-1].add(Node("tbody")))
        elif tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self.open.append(self.open[-1].add(Node("tbody")))
            self.open.append(self.open[-1].add(Node("tr")))
        node = self.open[-1].add(Node(tag, found))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and (tag in ("svg", "path", "math") or any(n.tag in ("svg", "math") for n in self.open)):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            if self.body is None and self.head is not None:
                self._enter_body()
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.handle_starttag("p", [])
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].tag
            if name == tag or tag in HEADINGS and name in HEADINGS:
                if k > 1 or self.open[k] not in (self.head, self.body):
                    del self.open[k:]
                return
            if name in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and (self.head is None or self.open[-1] is self.head):
            if not data.strip():
                return
            self._enter_body()
        last = self.open[-1]
        if last.children and not last.children[-1].tag:
            last.children[-1].text += data
        else:
            last.add(Node(text=data))


def parse_html(html: str) -> Node:
    """The document's tree: html with head and body, whatever the markup."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder._enter_body()
    return builder.document


def trim(text: str) -> str:
    """The text without blanks at its ends. Unlike str.strip, the separators U+001C to U+001F are none."""
    return text.strip(BLANKS)


def collapse(text: str) -> str:
    return " ".join(text.split())


def cut_bytes(text: str, size: int) -> str:
    """At most size bytes of UTF-8; a code point that would be split is left out."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= size else data[:size].decode("utf-8", "ignore")
