"""Pages to entity rows: a tolerant tree, exchangeable parsers."""

import pytest

from pairmill.sources import entities
from pairmill.sources.entities import tree


@pytest.mark.parametrize("html, want", [
    ("<p>a<p>b", ["a", "b"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<b>a<i>b</b>c</i> d</p></div>e", ["abc de"]),
    ("x<br>y<br/>z &amp; &lt;q&gt; &nbsp;w", ["x", "y", "z & <q> w"]),
    ("<script>var t='<p>no</p>'</script><style>p{}</style>yes<!-- no -->", ["yes"]),
    ("<table><tr><td>1<td>2<tr><th>3<td>4</table>5", ["1", "2", "3", "4", "5"]),
    ("<p>a <b>b<div>c</div>d", ["a b", "c", "d"]),
    ("<div>a</span>b</div>c", ["ab", "c"]),
    ("", []), ("no tags", ["no tags"]), ("a < b", ["a < b"]),
])
def test_lines(html, want):
    assert tree(html).lines() == want


def test_find():
    page = tree('<div class="a b" id=x><p class=b>one<p>two</div><p class="ab">three')
    assert [n.text() for n in page.all(cls="b")] == ["one two", "one"]
    assert page.first("p", "ab").text() == "three" and page.first(id="x").tag == "div" and page.first("table") is None


def test_deep_pages():
    """Nesting far beyond the interpreter's recursion limit."""
    assert tree("<div>" * 20_000 + "x").lines() == ["x"]


def test_entity_rows(spark):
    """No row for a null page and a page without entities; other columns stay; parsers are exchangeable."""
    rows = [(1, '<div class="resume-card"><a class=title href="/abc">A</a><li>s</div>' * 2, "x"), (2, None, None), (3, "", "y"), (4, "<div class='resume-card'>no link", "z")]
    pages = spark.createDataFrame(rows, "page int, html string, note string")
    got = [tuple(r) for r in entities.entity_rows(pages, entities.resume_list, entities.CARD).collect()]
    assert got == [(1, "x", "/abc", "A", "", "", ["s"])] * 2
    mine = entities.entity_rows(pages, lambda html: [(len(html), w) for w in html.split("<")[:1]], "size int, head string")
    assert sorted(tuple(r) for r in mine.collect()) == [(1, "x", len(rows[0][1]), ""), (3, "y", 0, ""), (4, "z", 32, "")]
    assert list(entities.vacancy_page("<p>no heading")) == [] and list(entities.profile_page("")) == [("", "", None)]
    assert entities.entity_rows(pages.limit(0), entities.resume_list, entities.CARD).collect() == []
