"""Tags, Markdown and article requests on literal inputs."""

import pytest
from pyspark.sql import functions as F

from webtide.functions.markdown import to_markdown
from webtide.functions.tags import anchors, attribute, first_image, head_tags, head_value
from webtide.operators.extraction import extract_pages, page_links
from webtide.plans.articles import build_articles
from webtide.plans.joins import BloomFilter

MARKDOWN = [
    ("<p>a</p><ul><li>one<ul><li>in1</li><li>in2<ol><li>x</li><li>y</li></ol></li></ul></li><li>two</li></ul><p>z</p>",
     "a\n\n- one\n  - in1\n  - in2\n    1. x\n    2. y\n- two\n\nz"),
    ("<ol><li>a</li><li>b</li><li>c</li></ol>", "1. a\n2. b\n3. c"),
    ("<ol start='9'><li>a</li><li><p>b</p><p>c</p></li><li>d</ol>x<br>y", "9. a\n10. b\n\n    c\n\n11. d\n\nx  \ny"),
    ("<table><thead><tr><th>A</th><th>B</th></tr></thead><tr><td>1</td><td><p>2</p></td></tr></table>tail", "| A | B |\n| --- | --- |\n| 1 | 2 |\n\ntail"),
    ("<tr><td>a<td>b<tr><td>c", "| a | b |\n| --- | --- |\n| c |"),
    ("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>", "| a in | b |\n| --- | --- |"),
    ("<blockquote><p>q1</p><blockquote>q2</blockquote><ul><li>i</li></ul></blockquote>after", "> q1\n> >\n> > q2\n>\n> - i\n\nafter"),
    ('<pre><code class="hl language-js">let x = 1;\n\n  y &lt; 2</code></pre><p>t <code>in</code> e</p>', "```js\nlet x = 1;\n\n  y < 2\n```\n\nt `in` e"),
    ("<h2>He<b>ad</b></h2>text <b>bold <i>it</i></b> <b>open", "## He**ad**\n\ntext **bold *it*** open"),
    ('<a title="1 > 0" data-href="no" href="/z">zz</a> <img alt="q>" src=a.png>', "[zz](/z) ![q>](a.png)"),
    ("<a href='/a'>one<a href='/b'>two</a> <a>three</a>", "[one](/a)[two](/b) three"),
    ("<p>fine <a href=x.html>off</p>", "fine [off](x.html)"),
    ("<li>a<li>b", "- a\n- b"),
    ("<ul><li></li><li><blockquote>q<br>r</blockquote></li></ul>", "- > q  \n  > r"),
    ("a < b <3 <!-- c --> <script>x</script>d", "a < b <3  d"),
    ("<div>one\n  two</div>\n<hr>three", "one two\n\n---\n\nthree"),
    ("</ul></li></blockquote></table></a>x", "x"),
    ("", ""), ("   ", ""), (None, ""),
]


def test_markdown_of_fragments(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "i int, h string")
    got = {r.i: r.md for r in df.select("i", to_markdown("h").alias("md")).collect()}
    for i, (html, want) in enumerate(MARKDOWN):
        assert got[i] == want, html


def test_markdown_of_long_pages(spark):
    """More tokens than a chunk; the work grows with the page."""
    html = "<ul>" + "".join(f"<li>item {i} <a href='/{i}'>l</a></li>" for i in range(20_000)) + "</ul>"
    deep = "<ul><li>" * 300 + "x"
    df = spark.createDataFrame([(1, html), (2, deep), (3, "<a '" * 30_000), (4, "<b>" * 20_000 + "y")], "i int, h string")
    got = {r.i: r.md for r in df.select("i", to_markdown("h").alias("md")).collect()}
    lines = got[1].split("\n")
    assert len(lines) == 20_000 and lines[-1] == "- item 19999 [l](/19999)"
    assert got[2].endswith("- x") and got[4] == "y" and got[3].startswith("<a '")


def test_attributes(spark):
    tag = """<a data-href="no" title='href="x"' HREF = "/y" href=/z disabled id=q>"""
    one = spark.createDataFrame([(tag,)], "t string")
    got = one.select(*[attribute(F.col("t"), k).alias(f"c{i}") for i, k in enumerate(("href", "data-href", "title", "id", "disabled", "x"))]).first()
    assert tuple(got) == ("/y", "no", 'href="x"', "q", None, None)


def test_head_tags_and_links(spark):
    html = (
        "<html class='a > b' LANG='de-AT'><head><meta content='T > 1' property='og:title'><meta name=description content=Short>"
        "<link rel='preload' href='/p.js'><link href=i.png rel='apple-touch icon'></head><body><time>x</time><time datetime='2020-01-02'>t</time>"
        "<a data-href=no>none</a><a title='1 > 0' href='b/c'>text <b>it</b></a><a\nhref=//h.example/x>y</a><abbr href='/n'>n</abbr>"
        "<img data-src='no.png'><img alt='>' src='yes.png'></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://ex.com/a/", html)], "page_id long, url string, html string")
    r = extract_pages(pages).first()
    assert (r.title, r.description, r.date, r.lang, r.favicon) == ("T > 1", "Short", "2020-01-02", "de", "https://ex.com/a/i.png")
    assert [(x.pos, x.href, x.text) for x in page_links(pages).collect()] == [(1, "https://ex.com/a/b/c", "text it"), (2, "https://h.example/x", "y")]
    t = pages.select(head_tags("html").alias("t"), first_image(F.col("html")).alias("img"))
    assert t.select(head_value("t", "link", key_pattern="^preload$")).first()[0] == "/p.js" and t.first().img == "yes.png"
    assert [x.href for x in pages.select(F.explode(anchors(F.col("html"))).alias("a")).select("a.href").collect()] == ["b/c", "//h.example/x"]


@pytest.mark.parametrize("n", [0, 3, 50_000])
def test_bloom_filter(spark, n):
    pairs = spark.range(n).select(F.concat(F.lit("https://ex.com/"), "id").alias("url"), F.when(F.col("id") % 3 == 0, "raw").otherwise("md").alias("kind"))
    bloom = BloomFilter(pairs, "url", "kind")
    asked = spark.range(2 * n + 1000).select("id", F.concat(F.lit("https://ex.com/"), "id").alias("url"))
    got = bloom.meet(asked, "url", {"raw": "raw", "md": "md"})
    assert got.columns == ["id", "url", "raw", "md"]
    hit = got.where(F.col("id") < n)
    assert hit.count() == n and hit.where("raw" if n == 0 else "id % 3 = 0 and not raw or id % 3 <> 0 and not md").count() == 0
    assert got.where(F.col("id") >= n).count() <= 0.05 * (n + 1000)


def test_articles_ship_the_body_asked_for(spark):
    pages = spark.createDataFrame(
        [(i, f"https://ex.com/{i}", f"<html><body><article><p>One {i}</p></article></body></html>") for i in range(6)], "page_id long, url string, html string"
    )
    requests = spark.createDataFrame(
        [(1, "https://ex.com/1", "extractor", True), (2, "https://ex.com/2", "extractor", False), (3, "https://ex.com/3", "playwright", True),
         (4, "https://ex.com/3", "extractor", False), (5, "https://ex.com/none", "playwright", False), (6, None, None, None)],
        "req_id long, url string, mode string, raw_body boolean",
    )
    got = {r.req_id: (r.body, r.word_count, r.error_code) for r in build_articles(pages, requests).collect()}
    assert got[1] == ("<p>One 1</p>", 2, None) and got[2] == ("One 2", 2, None)
    assert got[3] == ("<p>One 3</p>", 2, None) and got[4] == ("One 3", 2, None)
    assert got[5][2] == 422 and got[6][0] is None and len(got) == 6
