"""Landed pages to entity rows (S17, S18, UDF4): a Python table function around
an exchangeable parser, from one page to any number of typed rows.

A parser is a function from the text of a page to tuples; ``entity_rows`` runs
it beside each page.  The parsers below read a tree that takes pages as they
come: tags that were never closed, closed twice or in the wrong order,
character references, scripts that hold tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript", "head"}
INLINE = {"a", "abbr", "b", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
#: an opening tag ends these, up to the next one of the second set
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


class Node:
    """An element: ``tag``, ``attrs`` and ``parts`` (texts and elements, in order)."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in page order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.parts) if isinstance(x, Node)]

    def all(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Iterator[Node]:
        """Elements below with this tag, class and attributes."""
        for node in self.walk():
            if (node is not self and (tag is None or node.tag == tag) and (cls is None or cls in node.attrs.get("class", "").split())
                    and all(node.attrs.get(k) == v for k, v in attrs.items())):
                yield node

    def first(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Node | None:
        return next(self.all(tag, cls, **attrs), None)

    def lines(self) -> list[str]:
        """The visible text, a line a block, white space as one space, without empty lines."""
        out, line = [], []

        def end() -> None:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                out.append(text)
        todo: list = [self]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                end()
            elif x is self or x.tag not in HIDDEN:
                if x.tag not in INLINE:
                    end()
                    todo.append(None)
                todo += reversed(x.parts)
        end()
        return out

    def text(self) -> str:
        return " ".join(self.lines())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("page", {})
        self.open = [self.root]

    def _end(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag not in INLINE and tag not in VOID:
            # a block ends an open paragraph
            self._end({"p"}, {x.tag for x in self.open[1:] if x.tag not in INLINE and x.tag != "p"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # an inline element does not end the block that it was opened outside of
        self._end({tag}, {x.tag for x in self.open[1:] if x.tag not in INLINE} - {tag} if tag in INLINE else set())

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str) -> Node:
    """The page as a tree; any text gives one."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def entity_rows(pages: DataFrame, parser: Callable[[str], Iterable[tuple]], schema: str, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` without its text, beside the rows (``schema``) that ``parser`` finds on each page.

    A null page, and one on which the parser finds nothing, has no row.  Pages
    are independent, so the function runs where they are read.
    """
    @F.udtf(returnType=schema)
    class Rows:
        def eval(self, html):
            if html is not None:
                yield from parser(html)

    return pages.lateralJoin(Rows(F.col(html_col).outer())).drop(html_col)


# ---------------------------------------------------------------- parsers


def _text(node: Node | None) -> str:
    return node.text() if node is not None else ""


VACANCY = "title string, name string, area string, body string"


def vacancy_page(html: str) -> Iterator[tuple]:
    """A vacancy page: its title, heading, area and the lines of its main part; none without a heading."""
    page = tree(html)
    heading = page.first("h1")
    if heading is None:
        return
    main = page.first("main") or page
    yield _text(page.first("title")), heading.text(), _text(page.first(cls="area")), "\n".join(main.lines())


CARD = "href string, position string, salary_text string, area string, skills array<string>"


def resume_list(html: str) -> Iterator[tuple]:
    """A page of a résumé list: a row for each card."""
    for card in tree(html).all(cls="resume-card"):
        link = card.first("a", "title")
        if link is not None and link.attrs.get("href"):
            skills = [s for s in (x.text() for x in card.all("li")) if s]
            yield link.attrs["href"], link.text(), _text(card.first(cls="salary")), _text(card.first(cls="area")), skills


PROFILE = "name string, body string, state string"


def profile_page(html: str) -> Iterator[tuple]:
    """A profile: the name, the lines of the page, and the JSON state of its script."""
    page = tree(html)
    name = page.first("h2")
    state = page.first("script", id="state")
    yield _text(name), "\n".join(page.lines()), "".join(x for x in state.parts if isinstance(x, str)) if state is not None else None
