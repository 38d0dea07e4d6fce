"""Literal tables with results written by hand."""

import tracemalloc
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webmill.functions import arrow, markdown, text, urls
from webmill.operators import pages

CANONICAL = [
    ("HTTPS://WWW.Example.COM/", "https://www.example.com/", None),
    ("https://a.com/x#top", "https://a.com/x", None),
    ("https://a.com?", "https://a.com/", None),
    ("https://a.com/?a", "https://a.com/?a=", None),
    ("https://a.com/?b=2&a=1&a=0", "https://a.com/?a=1&a=0&b=2", None),
    ("https://a.com/?q=a%20b", "https://a.com/?q=a+b", None),
    ("https://a.com/?q=%zz%20", "https://a.com/?q=%25zz+", None),
    ("https://a.com/?utm_source=x&fbclid=1&ref=y&k=%C3%A9~*", "https://a.com/?k=%C3%A9%7E*", None),
    ("https://a.com:443/x", "https://a.com/x", None),
    ("http://a.com:8080", "http://a.com:8080/", None),
    ("https://a.com/a/../b", "https://a.com/b", None),
    ("https://a.com/a/b/..", "https://a.com/a/", None),
    ("https://u:p@a.com/", "https://u:p@a.com/", None),
    ("https://[::1]/x", "https://[::1]/x", None),
    ("https://2130706433/", "https://127.0.0.1/", None),
    ("https://0x7f.1/", "https://127.0.0.1/", None),
    ("https://256.1.1.1/", None, "invalid"),
    ("https://a.com/é b", "https://a.com/%C3%A9%20b", None),
    ("  https:a.com\\b ", "https://a.com/b", None),
    ("https://é.com/", "https://xn--9ca.com/", None),
    ("https://BÜCHER.de/x", "https://xn--bcher-kva.de/x", None),
    ("https://0x000000000007f.0000000000000000001/", "https://127.0.0.1/", None),
    ("https://a%20b.com/", None, "unsupported"),
    ("https://a.com:99999/", None, "invalid"),
    ("https:///", None, "invalid"),
    ("not a url", None, "invalid"),
    ("mailto:x@y.z", None, "unsupported"),
    ("", None, "missing"),
    (None, None, "missing"),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CANONICAL)], "i int, url string")
    got = {r.i: (r.canonical, r.url_error) for r in pages.canonicalise(df).collect()}
    assert got == {i: (c, e) for i, (_, c, e) in enumerate(CANONICAL)}


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame([(c,) for _, c, _ in CANONICAL if c], "url string")
    assert all(r.url == r.canonical for r in pages.canonicalise(df).collect())


@pytest.mark.parametrize("url,seed", [
    ("http://www.a.com/x?utm_term=1", "http://a.com/x"),
    ("https://a.com/report.xlsx", None),
    ("https://a.com/report.dat", "https://a.com/report.dat"),
    ("https://a.com/page.ai", None),
    ("ftp://a.com/x", None),
])
def test_seed_form(spark, url, seed):
    df = spark.createDataFrame([(url,)], "url string")
    assert pages.normalise_seeds(df).first().seed_url == seed


def test_private_hosts(spark):
    cases = {"10.0.0.1": True, "172.15.0.1": False, "172.16.0.1": True, "172.32.0.1": False, "localhost": True,
             "x.local": True, "x.internal": True, "[::1]": False, "a.com": False, None: False}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    flagged = pages.flag_private_hosts(pages.flag_private_hosts(df), strict=True, out="strict").collect()
    assert {r.host: r.is_private for r in flagged} == cases
    assert {r.host for r in flagged if r.strict} == {h for h, p in cases.items() if p} | {"[::1]"}


def test_token_estimate_counts_utf16_units(spark):
    cases = {"": 0, "abcd": 1, "abcde": 2, "\U0001F600\U0001F600": 1, "\U0001F600\U0001F600\U0001F600": 2}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.withColumn("n", text.estimate_tokens(F.col("t"))).collect()} == cases
    assert spark.range(1).select(text.estimate_tokens(F.lit(None).cast("string"))).first()[0] == 0


def test_savings_round_half_up_and_undefined(spark):
    cases = [(200, 175, 13), (200, 205, -2), (100, 100, 0), (0, 5, None), (5, 0, None), (None, 5, None), (10, 30, -200)]
    df = spark.createDataFrame(cases, "h int, m int, want int")
    for r in df.withColumn("got", text.savings_pct(F.col("h"), F.col("m"))).collect():
        assert r.got == r.want


def test_html_guard(spark):
    cases = {"﻿ <!DOCTYPE html>": True, " <HTML>": True, "<?xml version": True, "<!-- x --><p><html>": True,
             "<!-- x --> text": False, "# Title <html>": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.withColumn("x", text.looks_like_html(F.col("t"))).collect()} == cases


def test_byte_labels(spark):
    cases = {0: "— B", None: "— B", 1: "4 B", 256: "1 KB", 320: "1.3 KB", 262144: "1 MB", 268435456: "1 undefined"}
    df = spark.createDataFrame([(k,) for k in cases], "t int")
    assert {r.t: r.x for r in df.withColumn("x", text.byte_label(F.col("t"))).collect()} == cases


PAGE = """<!doctype html><html><head><title>T</title><script>x="<main>"</script></head><body><nav>menu</nav><MAIN>
<h1>Pricing</h1><p>1,000 free
 renders/month. <B>bold </B> <a class="x" href="/u?a=1&amp;b=2">li<span>n</span>k</a> <img src="s.png" alt="al"></p>
<pre><code class="py">def f():
    return  1 &lt; 2
</code></pre><ul><li>one</li><li><strong>Two</strong>: x</li></ul><ol><li>a</li><li>b</li></ol>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
&copy; &#169;&#x1F600; &amp;lt; 3 < 4<br>end<hr></MAIN><footer>f</footer></body></html>"""
MARKDOWN = """# Pricing

1,000 free renders/month. **bold** [link](/u?a=1&b=2) ![al](s.png)

```
def f():
    return  1 < 2
```

-   one
-   **Two**: x

1.  a
2.  b

| A | B |
| --- | --- |
| 1 | 2 |

© ©\U0001F600 &lt; 3 < 4
end

* * *"""


def test_extraction(spark):
    shell = '<html><body><div id="root"></div><noscript>needs scripts</noscript></body></html>'
    rows = pages.extract_markdown(spark.createDataFrame([(1, PAGE), (2, shell)], "id int, html string")).collect()
    by = {r.id: r for r in rows}
    assert by[1].markdown == MARKDOWN and not by[1].needs_render
    assert by[2].markdown is None and by[2].needs_render and by[2].md_tokens == 0


@pytest.mark.parametrize("html,want", [
    ("<body><nav>a<nav>b</nav>MENU</nav>text</body>", "text"),
    ("<body><div><nav>MENU</div>text</body>", "text"),
    ("<body>x<script>var secret=1;", "x"), ("<p>x<!-- never closed", "x"), ("<style>p{}</STYLE >y", "y"),
    ("<ol><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ol>", "1.  a\n    1.  b\n    2.  c\n2.  d"),
    ("<ol start=3><li>a<ul><li>b</ul><li>c</ol>", "3.  a\n    -   b\n4.  c"),
    ("<p>a<a title='a>b' href='/x'>t</a></p>", "a[t](/x)"), ("<p>a <a href=/x?a=1&amp;b=2> t </a>b", "a [t](/x?a=1&b=2) b"),
    ("<main>a</main>between<main>b</main>", "a\n\nb"), ("<article>x<main>m</main></article><article>y</article>", "m"),
    ("<ul><li><p>x</p><p>y</p><li>z</ul>", "-   x\n\ny\n\n-   z"), ("<p>one <b>two</p><p>three</b> x", "one two\n\nthree x"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"), ("<p>a <b> b </b>c <em><b>d</b></em></p>", "a **b** c _**d**_"),
    ("<table><tr><td>a<table><tr><td>n</td></tr></table><td>b<tr><td>c</table>after", "| a n | b |\n| --- | --- |\n| c |\n\nafter"),
    ("<pre>\na\n  ```b\n</pre>", "````\na\n  ```b\n````"), ("a <span> b</span> <x-y>c</x-y> 1 < 2 <3", "a b c 1 < 2 <3"),
    ("<a href=x><h2>T</h2></a>", "## T"), ('<p title="never closed>x</p><p>y</p>', "x\n\ny"), ("", None), (None, None), ("<div></div>", None),
    ("<svg><title>t</title><text>v</text></svg><template><p>h</template>z", "z"), ("<html><head><title>t</title><body><p>b", "b"),
])
def test_extraction_balances_tags(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert pages.extract_markdown(df).first().markdown == want


@pytest.mark.parametrize("piece", ['<a "', "<", '<a href="x', "<div>", "<p>", "<li>", "</div>", "<ul><li>", "<!", "<b>x</i>", "<table><tr><td>", "&amp", "<script>", "<!--"])
def test_extraction_time_is_linear(piece):
    markdown.read(piece * 20_000).markdown()  # quadratic work would take minutes


def test_demo_pair(spark):
    html = ("<!doctype html>\n<html>\n  <head>\n    <title>Pricing</title>\n  </head>\n  <body>\n    <main>\n"
            "      <h1>Pricing</h1>\n      <p>1,000 free renders/month. No credit card required.</p>\n    </main>\n  </body>\n</html>")
    row = pages.extract_markdown(spark.createDataFrame([(html,)], "html string")).first()
    assert row.markdown == "# Pricing\n\n1,000 free renders/month. No credit card required."


def test_nothing_is_invented(spark):
    row = pages.equivalence_audit(spark.createDataFrame([(1, PAGE)], "id int, html string")).first()
    assert row.invented_words == 0 and row.kept_words == row.main_words


def test_a_word_that_the_page_does_not_show_is_found(spark):
    html = "<body><nav>menu</nav><p>shown <i>also</i><script>hidden()</script></body>"
    row = pages.equivalence_audit(spark.createDataFrame([(html,)], "html string")).first()
    assert (row.invented_words, row.main_words, row.kept_words) == (0, 2, 2)
    page = markdown.read(html)
    assert page.words().split() == ["menu", "shown", "also"] and page.words(main=True).split() == ["shown", "also"]


def test_hosts(spark):
    row = spark.createDataFrame([("https://WWW.A.com/",)], "h string").select(
        urls.host_from_input(F.col("h"))).first()
    assert row[0] == "a.com"


def test_filters_do_not_repeat_the_extraction(spark):
    df = pages.extract_markdown(spark.createDataFrame([(PAGE,)], "html string")).filter("markdown is not null")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("markdown_of(") == 1


@pytest.mark.parametrize("source,want", [
    ("caf&eacute; &notin; &nbsp;&amp;", "café ∉  &"), ("&#38;lt; &amp;lt;", "&lt; &lt;"), ("&#0000000065;&#x000041;", "AA"),
    ("&#0; &#xD800; &#1114112; &#99999999999;", "&#0; &#xD800; &#1114112; &#99999999999;"), ("a & b &c &nope; &;", "a & b &c &nope; &;"),
    ("&#128512;&lt;&gt;", "😀<>"), ("&&amp;", "&&"), (None, None),
])
def test_character_references_are_decoded_once(spark, source, want):
    df = spark.createDataFrame([(source,)], "t string")
    assert df.select(markdown.decode_entities(F.col("t")).alias("t")).first().t == want


def test_extraction_holds_one_page_at_a_time(monkeypatch):
    """A batch of pages is neither folded nor listed whole (F1)."""
    alive, most, read = weakref.WeakSet(), [0], markdown.read

    def counted(html):
        page = read(html)
        alive.add(page)
        most[0] = max(most[0], len(alive))
        return page

    monkeypatch.setattr(markdown, "read", counted)
    pages = [f"<body><nav>n</nav><p>text {i}</p></body>" for i in range(500)] + [None, ""]
    found = [row for part in markdown.views_of.func(iter([pa.array(pages), pa.array([], pa.string())])) for row in part.to_pylist()]
    assert [f["markdown"] for f in found] == [f"text {i}" for i in range(500)] + [None, None]
    assert found[7]["shown"].split() == ["n", "text", "7"] and found[7]["main"].split() == ["text", "7"]
    assert found[500]["shown"] is None and found[501]["shown"] == ""
    assert most[0] <= 2


def test_pieces_of_batches_are_bounded():
    texts = ["abc", None, "", "x" * 50, "de", "f" * 9, "g"]
    parts = list(arrow.pieces(iter([pa.array(texts), pa.array(["z"])]), limit=10))
    assert parts == [["abc", None, ""], ["x" * 50], ["de"], ["f" * 9, "g"], ["z"]]


def test_markdown_comes_in_pieces_of_a_batch():
    """Neither the pages nor the Markdown of a batch are held at once (F2 to F5)."""
    pages = [f"<p>{i} {'x' * 400_000}</p>" for i in range(8)] + [None]
    parts = [part.to_pylist() for part in markdown.markdown_of.func(iter([pa.array(pages)]))]
    assert [len(p) for p in parts] == [2, 2, 2, 3]
    assert [m and m[0] for p in parts for m in p] == [*map(str, range(8)), None]


def test_python_memory_of_extraction_does_not_follow_the_batch():
    """Batches fill up as the table grows; the Python memory of ``s6_content_store`` must not grow with them (F7)."""
    def most(rows):
        batch = pa.array([f"<p>{i} {'x' * 20_000}</p>" for i in range(rows)])
        tracemalloc.start()
        try:
            assert sum(len(part) for part in markdown.markdown_of.func(iter([batch]))) == rows
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    most(10)  # what is made once
    assert most(1_000) < 1.2 * most(250) < 10 * arrow.SLICE_BYTES
