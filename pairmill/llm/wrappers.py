"""HTML extraction by inferred wrappers.

Pages of a host are aligned with one another into a wrapper, a regular
expression without unions: element signatures in order, where an element that
some pages lack is optional, neighbours of one signature are a repeated group,
and texts are slots.  Each task folds the pages it reads into one partial
wrapper a host, partial wrappers are merged in two steps, and the wrapper's
slot figures name the host's main region and the parts of it that are not
article text.  Pages are then read once more and cut by their host's rules.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_arrow, staged

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas video audio select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELL = frozenset("td th caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element on the left ends when one on the right begins.
ENDS = {"p": BLOCK - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
        "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"}}
#: No implied end reaches past these.
WALLS = frozenset("table td th div article section main aside ul ol dl body blockquote".split())

# Names of parts that are not article text.
NOT_TEXT = frozenset("nav footer aside form menu dialog script style".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promotion recommended recommendations related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola teaser teasers toolbar widget widgets".split())
HEADER_WORDS = frozenset(["header"])
MAIN_WORDS = frozenset("article content entry main post story text".split())
NEGATED = frozenset("with has no without".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

DEPTH = 80  # deeper elements count as part of their ancestor
MERGE = 512  # partial wrappers of a host are merged in so many groups, then those
HOSTS = 2000  # wrappers a task holds before it hands them on
END = object()  # a block ends


class Node:
    __slots__ = ("tag", "sig", "kids")

    def __init__(self, tag: str, sig: str):
        self.tag, self.sig, self.kids = tag, sig, []


def signature(tag: str, attrs: str) -> str:
    """Element name and the words of its class, id, role and itemprop, without numbers."""
    words: list[str] = []
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.append("hidden!")
        elif name not in ("style", "hidden", "aria-hidden"):
            found = [w.lower() for w in WORD.findall(html.unescape(value))]
            words += [w for k, w in enumerate(found) if not (k and found[k - 1] in NEGATED)]
    return ".".join([tag, *sorted(set(words))])


def parse(page: str | None) -> Node:
    """The element tree.  Texts are strings with references decoded, those of links (text,) tuples, breaks None.

    Inline elements without a name of their own, comments and raw elements'
    contents are left out; missing end tags are implied.
    """
    root = Node("", "")
    stack: list[Node | str] = [root]  # a string: an inline element that makes no node
    here, links, at = root, 0, 0
    page = page or ""
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at: m.start() if m else len(page)]
        if text:
            said = html.unescape(text)
            here.kids.append((said,) if links else said)
        if not m:
            break
        at = m.end()
        tag = (m["name"] or m["name2"] or "").lower()
        if not tag:
            continue
        close, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if close:
            if tag in ("p", "br") and not any(isinstance(x, Node) and x.tag == tag for x in stack):
                here.kids.append(None)
                continue
            for k in range(len(stack) - 1, 0, -1):
                x = stack[k]
                if (x.tag if isinstance(x, Node) else x) == tag:
                    links -= sum(y == "a" for y in stack[k:] if isinstance(y, str))
                    del stack[k:]
                    break
                if isinstance(x, Node) and x.tag in WALLS and tag not in BLOCK | CELL:
                    break  # a stray inline end tag
            here = next(x for x in reversed(stack) if isinstance(x, Node))
            continue
        if tag in ("br", "wbr"):
            here.kids.append(None if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                here.kids.append(Node("hr", "hr"))
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in BLOCK or tag in CELL:
            for k in range(len(stack) - 1, 0, -1):
                x = stack[k]
                if isinstance(x, Node):
                    if tag in ENDS.get(x.tag, ()):
                        links -= sum(y == "a" for y in stack[k:] if isinstance(y, str))
                        del stack[k:]
                        break
                    if x.tag in WALLS:
                        break
            here = next(x for x in reversed(stack) if isinstance(x, Node))
        sig = signature(tag, attrs)
        if tag in BLOCK or tag in CELL or (sig != tag and tag != "a"):
            node = Node(tag, sig)
            here.kids.append(node)
            stack.append(node)
            here = node
        else:
            stack.append(tag)
            links += tag == "a"
    return root


# Wrapper elements are lists, ready for JSON: signature, pages, optional, repeated, characters, link characters, children.
SIG, PAGES, OPTIONAL, REPEATED, CHARS, LINKED, KIDS = range(7)


def skeleton(root: Node) -> list:
    """A page's own wrapper: the tree with text slots, neighbours of one signature folded into a repeated group."""
    top = [root.sig, 1, 0, 0, 0, 0, []]
    todo = [(root, top, 0)]
    made = [top]
    while todo:
        node, out, depth = todo.pop()
        for kid in node.kids:
            if isinstance(kid, Node):
                if depth >= DEPTH:
                    todo.append((kid, out, depth))
                    continue
                new = [kid.sig, 1, 0, 0, 0, 0, []]
                out[KIDS].append(new)
                made.append(new)
                todo.append((kid, new, depth + 1))
            elif kid is not None:
                said = kid[0] if isinstance(kid, tuple) else kid
                n = len("".join(said.split()))
                if n:
                    slot = ["#", 1, 0, 0, n, n * isinstance(kid, tuple), []]
                    out[KIDS].append(slot)
    for node in reversed(made):
        node[KIDS] = fold(node[KIDS])
    return top


def fold(kids: list[list]) -> list[list]:
    """Neighbours, or neighbouring runs of two or three, of the same signatures become one repeated group."""
    for size in (1, 2, 3):
        out: list[list] = []
        at = 0
        while at < len(kids):
            if len(out) >= size and at + size <= len(kids) and [x[SIG] for x in out[-size:]] == [x[SIG] for x in kids[at: at + size]]:
                for k in range(size):
                    out[k - size] = join(out[k - size], kids[at + k], same_page=True)
                    out[k - size][REPEATED] = 1
                at += size
            else:
                out.append(kids[at])
                at += 1
        kids = out
    return kids


def join(a: list, b: list, same_page: bool = False) -> list:
    """Two elements of one signature as one; their children are aligned."""
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    return [a[SIG], pages, a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED],
            align(a[KIDS], b[KIDS], same_page)]


def align(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """A longest common order of signatures; what only one side has becomes optional."""
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [join(x, y, same_page) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append(join(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        else:
            x = a[i] if j == m or i < n and best[i + 1][j] >= best[i][j + 1] else b[j]
            i, j = (i + 1, j) if j == m or i < n and best[i + 1][j] >= best[i][j + 1] else (i, j + 1)
            x[OPTIONAL] = 1
            out.append(x)
    return fold(out)


def words_of(sig: str) -> tuple[str, set[str]]:
    tag, *words = sig.split(".")
    return tag, set(words)


def excluded(sig: str) -> bool:
    tag, words = words_of(sig)
    if "hidden!" in words:
        return True
    if tag in ("html", "body", "main", ""):
        return False
    if tag == "article":
        return bool(words & {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "related", "teaser"})
    return tag in NOT_TEXT or bool(words & NOT_TEXT_WORDS)


def is_header(sig: str) -> bool:
    tag, words = words_of(sig)
    return tag == "header" or bool(words & HEADER_WORDS) and tag not in ("body", "html", "article", "main")


def rules(wrapper: list) -> dict:
    """Where a host's article text is: main paths, best first, and link lists to leave out."""
    found: list[tuple[int, float, int, tuple]] = []
    lists: list[tuple] = []
    weight: dict[tuple, float] = {}
    seen = 0

    def walk(node: list, path: tuple) -> tuple[int, int]:
        """Characters and link characters of what is not excluded."""
        nonlocal seen
        chars, linked = node[CHARS], node[LINKED]
        seen += 1
        order = seen
        for kid in node[KIDS]:
            if kid[SIG] == "#":
                chars, linked = chars + kid[CHARS], linked + kid[LINKED]
            elif not excluded(kid[SIG]) and not (is_header(kid[SIG]) and not path_is_main(path)):
                c, k = walk(kid, (*path, kid[SIG]))
                chars, linked = chars + c, linked + k
        tag, words = words_of(node[SIG])
        if tag in ("ul", "ol", "menu", "div", "section", "table") and not path_is_main(path) and chars and linked > 0.8 * chars and node[REPEATED] + sum(k[REPEATED] for k in node[KIDS]):
            lists.append(path)
            return 0, 0
        weight[path] = weight.get(path, 0) + chars
        kind = 0 if tag == "article" or "articlebody" in words or {"article", "body"} <= words else 1 if tag == "main" or "main!" in words else \
            2 if words & MAIN_WORDS and tag not in HEADING else 9
        if path and chars and kind < 9:
            found.append((kind, -chars, order, path))
        return chars, linked

    walk(wrapper, ())
    # a main element inside one of its own kind says the same; the outer one is whole
    best: dict[tuple, tuple] = {}
    for kind, chars, order, path in sorted(found):
        if path not in best and not any(path[: len(p)] == p for p in best):
            best[path] = (kind, chars, order)
    ranked = [p for p, _ in sorted(best.items(), key=lambda x: x[1])]
    # without any such name: down from the top as long as one child holds nearly everything
    path: tuple = ()
    total = weight.get((), 0)
    while True:
        inner = [(c, p) for p, c in weight.items() if len(p) == len(path) + 1 and p[: len(path)] == path]
        c, p = max(inner, default=(0, ()))
        if not p or c < 0.8 * total or words_of(p[-1])[0] not in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center"):
            break
        path, total = p, c
    ranked.append(path)
    return {"main": [list(p) for p in ranked], "lists": [list(p) for p in lists]}


def path_is_main(path: tuple) -> bool:
    return any(words_of(s)[0] in ("article", "main") or words_of(s)[1] & MAIN_WORDS for s in path)


def text_of(root: Node, rule: dict | None) -> str:
    """The article's blocks, one a line.  Of a page's main elements of the best rank found, all are read."""
    rule = rule or rules(skeleton(root))
    main, lists = [tuple(p) for p in rule["main"]], {tuple(p) for p in rule["lists"]}
    by_path: dict[tuple, list[Node]] = {}
    wanted = set(main)
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        node, path = todo.pop()
        if path in wanted:
            by_path.setdefault(path, []).append(node)
        for kid in reversed(node.kids):
            if isinstance(kid, Node) and len(path) < DEPTH and not excluded(kid.sig):
                todo.append((kid, (*path, kid.sig)))
    for path in main:
        lines: list[str] = []
        for node in by_path.get(path, ()):
            lines += blocks(node, path, lists)
        if lines:
            return "\n".join(lines)
    return ""


def blocks(top: Node, path: tuple, lists: set[tuple]) -> list[str]:
    lines: list[str] = []
    words: list[str] = []

    def end() -> None:
        line = " ".join("".join(words).split())
        if line:
            lines.append(line)
        words.clear()

    # what to do next, last first: a node to enter, or a mark that one ends
    todo: list = [(top, path, False)]
    while todo:
        kid, at, titles = todo.pop()
        if kid is None:
            words.append(" ")
        elif kid is END:
            end()
        elif isinstance(kid, (str, tuple)):
            if not titles:
                words.append(kid if isinstance(kid, str) else kid[0])
        else:
            if titles and kid.tag in HEADING:
                titles = False
            elif kid is not top and is_header(kid.sig):
                titles = True  # of a header inside the article, its titles are article text
            if kid.tag in BLOCK:
                end()
                todo.append((END, at, titles))
            elif kid.tag in CELL:
                words.append(" ")
                todo.append((None, at, titles))
            for x in reversed(kid.kids):
                if isinstance(x, Node):
                    p = (*at, x.sig) if len(at) < DEPTH else at
                    if not excluded(x.sig) and not (p in lists and p != at):
                        todo.append((x, p, titles))
                else:
                    todo.append((x, at, titles))
    end()
    return lines


def host_of(url: Column) -> Column:
    """Host of a URL, lower case; the empty text where there is none."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def _merge(host: str, found: Iterator[str]) -> str:
    out = None
    for x in map(json.loads, found):
        out = x if out is None else join(out, x)
    return json.dumps(out)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host`` and ``wrapper`` (JSON), one row for each host; every page takes part."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        part = TaskContext.get().partitionId() % MERGE

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()),
                                               pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "part", "wrapper"])
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = skeleton(parse(page))
                held[host] = join(held[host], mine) if host in held else mine
                if len(held) >= HOSTS:
                    yield out()
                    held = {}
        if held:
            yield out()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "part": [key[1] if len(key) > 1 else 0], "wrapper": [_merge(key[0], rows["wrapper"])]})

    schema = "host string, part int, wrapper string"
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    parts = map_arrow(read, partial, schema)
    return parts.groupBy("host", "part").applyInPandas(merge, schema).groupBy("host").applyInPandas(merge, schema).select("host", "wrapper")


def host_rules(wrappers: DataFrame) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "rules": [json.dumps(rules(json.loads(w))) for w in b["wrapper"]]})
    return wrappers.mapInPandas(make, "host string, rules string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text``, the main text of the whole html.

    A column of that name is replaced.  Null and empty pages, and pages with
    no text outside menus and the like, give an empty text.  Pages without a
    host share one wrapper; repeated rows stay.  Broken markup is read as far
    as it goes.
    """
    out = pages.drop("text")
    host, rule = free_names([*out.columns, "text"], "host", "rules")
    known = staged(host_rules(infer(out, url_col, html_col)), "host-rules").toDF(host, rule)
    joined = out.withColumn(host, host_of(F.col(url_col))).join(known, host, "left").select(*out.columns, rule)
    names = out.columns
    schema = out.select("*", F.lit("").alias("text")).schema
    html_at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, dict | None] = {None: None}
        for b in batches:
            texts = []
            for page, r in zip(b.column(html_at).to_pylist(), b.column(len(names)).to_pylist()):
                if r not in read:
                    if len(read) > HOSTS:
                        read = {None: None}
                    read[r] = json.loads(r)
                texts.append(text_of(parse(page), read[r]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])
    return map_arrow(joined, run, schema)
