"""HTML -> text rule (I20): edge pages, and random pages against the standard library's
parser as the plain way."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postlytics.operators.html import STRETCH, TEXT_TAGS, VOID_TAGS, html_to_text, unescape


class _Plain(HTMLParser):
    """The rule by a parser's events; data events that follow each other are one text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text = [], [], ""

    def flush(self):
        piece, self.text = self.text.strip(), ""
        if piece and not any(tag == "template" for tag, _ in self.stack):
            for _, slot in self.stack:
                if slot is not None:
                    self.blocks[slot].append(piece)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in VOID_TAGS:
            slot = None
            if tag in TEXT_TAGS:
                self.blocks.append([])
                slot = len(self.blocks) - 1
            self.stack.append((tag, slot))

    def handle_startendtag(self, tag, attrs):
        self.flush()
        if tag in TEXT_TAGS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.text += data

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def plain(html):
    p = _Plain()
    p.feed(html)
    p.close()
    p.flush()
    return "\n".join("".join(b) for b in p.blocks)


EDGES = {
    "<p>a<p>b": "ab\nb",
    ('<html><head><style>p{x}</style><script>var t="</p>";</script></head>'
     '<body><h1>Tom &amp; Jerry</h1><!-- <p>hidden</p> --><p> one <b>two</b> </p></body></html>'): "Tom & Jerry\nonetwo",
    "<p>a<i>b</i>c</p><h2>x<br>y</h2>": "abc\nxy",
    "</p><p>x</div>y</p>z": "xy",
    "<div>no text tag</div>": "",
    "<p>a<template><b>x</b></template>c</p>": "ac",
    "<p>1 < 2 <3</p><h3></h3><p></p><p> e </p>": "1 < 2 <3\n\n\ne",
    "<p/><P CLASS='a>b' id=\"c>d\">e</P\n>f": "\ne",
    "<p>&lt;b&gt; &notit; &notin; &ampx &#65;&#x42;&#128;&#0;&#xD800;&#99999999999; &zzz; & &#; &#x1F600;</p>":
        "<b> ¬it; ∉ &x AB€��� &zzz; & &#; \U0001f600",
    "<p>a<!-- b": "a",
    "<p>a<script>b</p>": "a",
    "<p>a<b class=": "a",
    "<p title=x/y/>z": "z",
}


@pytest.fixture(scope="module")
def texts(spark):
    def run(pages):
        df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
        found = {r.id: r.plain for r in html_to_text(df).collect()}
        return [found[i] for i in range(len(pages))]
    return run


def test_edges(texts):
    assert dict(zip(EDGES, texts(list(EDGES)))) == EDGES


def test_random_pages_equal_the_plain_parser(texts):
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<h1 a=\"x>y\">", "</h1>", "<b>", "</b>", "<div class=c>", "</div>", "<br>", "<br/>", "<p/>", "<li>",
             "</ul>", "<!-- c <p> -->", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<template>", "</template>",
             "<!DOCTYPE html>", "text ", " more", "\n", "a < b", "&amp;", "&eacute;", "&copy", "&nosuch;", "&#233;", "é中", "5>4"]
    pages = ["<p>" + "".join(rng.choice(parts) for _ in range(rng.choice([3, 20, 60]))) for _ in range(300)]
    pages.append("<p>x" + "".join(f"<div><h2>{i}</h2>&amp;{i}</div>" for i in range(STRETCH)) + "</p>y")
    assert texts(pages) == [plain(p) for p in pages]


def test_long_runs_do_not_exhaust_the_stack(texts):
    n = 100_000
    attributes = "<p " + " ".join(f"a{i}='>'" for i in range(n)) + ">x</p>"
    signs = "<p>" + "< " * n + "</p>"
    got = texts([attributes, signs, "<p>" + "&amp;" * 5000 + "</p>", "<!--" + "-" * n + "x"])
    assert got == ["x", ("< " * n).strip(), "&" * 5000, ""]


def test_a_page_of_many_elements(texts):
    n = 20_000
    assert texts(["".join(f"<p>{i}</p>" for i in range(n))]) == ["\n".join(str(i) for i in range(n))]


def test_empty_and_null_rows_skipped(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, ""), (3, None), (4, "<div>no text tag</div>")],
                               "id long, html string")
    got = sorted((r.id, r.plain) for r in html_to_text(df).collect())
    assert got == [(1, "x"), (4, "")]
    assert html_to_text(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "id long, html string")
    plan = html_to_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "Exchange" not in plan


def test_every_named_reference(spark):
    from html import unescape as expected
    from html.entities import html5
    names = ["&" + k for k in html5] + [f"&#{i};" for i in range(0, 0x2FF)] + ["&#xfffe;", "&#xfdd0;", "&#x10ffff;", "&#x110000;"]
    df = spark.createDataFrame([(n, ) for n in names], "t string")
    bad = [(r.t, r.u) for r in df.select("t", unescape(F.col("t")).alias("u")).collect() if r.u != expected(r.t)]
    assert not bad
