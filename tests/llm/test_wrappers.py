import html
import json
import re

from pairmill.llm import wrappers as w
from pairmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_against_plain_cut(spark):
    """The pages of the tables have one article element each, of h1 and p blocks."""
    got = {r["page_id"]: r for r in QUERIES["op10_wrapper_extract"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


ARTICLE = """<h1>Title &amp; more</h1><p>One&nbsp;<b>bold</b>
 line&#33;<br>two</p><div class="ad">buy</div><ul><li>a</li><li>b <a href=x>link</a></ul><script>var x="</p>";</script>
 <table><tr><td>c1</td><td>c2</td></tr></table><aside>side</aside><form><input><p>sign</p></form><blockquote>q</blockquote>"""
WANT = "Title & more\nOne bold line! two\na\nb link\nc1 c2\nq"
SHELL = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><!-- <p>no</p> -->
<header class="site-header"><h2>Site</h2><nav><a href=/>home</a></nav></header><div id="cookie-notice">We use cookies</div>%s
<section id="comments"><h3>Comments</h3><article class="comment"><p>first!</p></article></section>
<div class="sidebar"><p>Popular</p></div><footer>(c) us</footer></body></html>"""


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, rules string")


def test_layouts(spark):
    bodies = {
        "a.example": f"<article>{ARTICLE}</article>",
        "b.example": f"<main><div class='c'>{ARTICLE}</div></main>",
        "c.example": f"<div id='wrap'><div class='post-content'>{ARTICLE}</div></div>",
        "d.example": f"<div><div>{ARTICLE}</div></div>",
        "e.example": f"<article><header><h1>Title &amp; more</h1><span class=by>By me</span></header>{ARTICLE.split('</h1>')[1]}<footer>tags</footer></article>",
    }
    rows = [(k * 100 + i, f"http://{h}/x/{i}", SHELL % b, None, None, None) for k, (h, b) in enumerate(bodies.items()) for i in range(4)]
    for r in w.extract(_pages(spark, rows)).collect():
        assert r["text"] == WANT, r["url"]


def test_edges(spark):
    nested = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>word &lt;b&gt;</p>" * 50_000 + "</article>"
    rows = [(1, "http://x.example/", None, "old", "h", "r"), (2, None, "", None, None, None), (3, "", "just text / here", None, None, None),
            (4, "nonsense", "<p>open <i>it <p>next", None, None, None), (5, "http://y.example", nested, None, None, None),
            (6, "http://z.example", long, None, None, None), (7, "http://z.example", "<article><p>short", None, None, None),
            (8, "http://q.example", "<article><p title='a>b' class=\"x>y\">one</p><p>two < three</article>", None, None, None),
            (8, "http://q.example", "<article><p title='a>b' class=\"x>y\">one</p><p>two < three</article>", None, None, None),
            (9, "http://v.example", "<article><p class='unclosed>gone</p><p>rest</p></article>", None, None, None)]
    out = w.extract(_pages(spark, rows))
    assert out.columns == ["page_id", "url", "html", "host", "rules", "text"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == got[2] == ""
    assert got[3] == "just text / here" and got[4] == "open it\nnext"
    assert got[5] == "deep" and got[6] == "\n".join(["word <b>"] * 50_000) and got[7] == "short"
    assert got[8] == "one\ntwo < three" and out.where("page_id = 8").count() == 2
    assert "rest" in got[9]
    assert w.extract(_pages(spark, [])).count() == 0


def test_wrapper_is_union_free_and_whole(spark):
    a = w.skeleton(w.parse("<article><h1>t</h1><p>a</p><p>b</p></article>"))
    b = w.skeleton(w.parse("<article><p>a</p><div class=note2>n</div></article>"))
    kids = w.join(a, b)[w.KIDS][0][w.KIDS]
    assert [(k[w.SIG], k[w.OPTIONAL], k[w.REPEATED]) for k in kids] == [("h1", 1, 0), ("p", 0, 1), ("div.note", 1, 0)]
    pages = [(i, "http://h.example/%d" % i, "<article><p>%s</p></article>" % ("x" * i), None, None, None) for i in range(1, 40)]
    r = w.infer(_pages(spark, pages).repartition(7)).collect()
    assert len(r) == 1
    top = json.loads(r[0]["wrapper"])[w.KIDS][0]
    assert top[w.PAGES] == 39 and top[w.KIDS][0][w.KIDS][0][w.CHARS] == sum(range(1, 40))


def test_link_lists_and_formulas_in_the_article_stay(spark):
    page = ("<body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><ul><li><a>Top one</a><li><a>Top two</a><li><a>Top three</a></ul>"
            "<article><h1>Head</h1><p>First</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
            "<p>Energy <math><mi>E</mi></math> of <button>this</button></p></article></body>")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in w.extract(df).collect()} == {"Head\nFirst\nOne\nTwo\nThree\nEnergy E of this"}
