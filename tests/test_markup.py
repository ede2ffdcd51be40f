"""Pages whose markup the patterns alone would misread."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_extraction import PAGES
from vacantia.operators.html import anchor_blocks, explode_anchors, explode_scripts, script_blocks, visible, with_blocks
from vacantia.operators.markup import misread, written_plainly

#: Page, its anchors (href, text, title), its scripts (id, body).
MISREAD = [
    ('<textarea name="x"><a href="/no">no</a><script>1</script><!-- </textarea><a href="/a">A</a>', [("/a", "A", "")], []),
    ('<title>a <a href="/no"> b</title><a href="/a">A</a><TITLE>x<y</TITLE >', [("/a", "A", "")], []),
    ('<iframe src=x><a href="/no">no</a></iframe><xmp><script>no</script></xmp><a href="/a">A</a>', [("/a", "A", "")], []),
    ('<a href="/a">see <textarea>1 &lt; <b>2</b> &amp;amp;</textarea></a>', [("/a", "see 1 < <b>2</b> &amp;", "")], []),
    ('<a href="/a">see <xmp>&lt;<b></xmp></a>', [("/a", "see &lt;<b>", "")], []),
    ('<p title="<a href=\'/no\'>no</a>">t</p><a href="/a" title="a<b>c">A</a>', [("/a", "A", "a<b>c")], []),
    ('<div data-x="<script>"><a href="/a">A</a></div><script id="s">x</script>', [("/a", "A", "")], [("s", "x")]),
    ("<div data-x='<!--'><a href=/a>A</a><style><a href=/no></style></div>", [("/a", "A", "")], []),
    ('<p title=<a href="/no">t</p><a href=/a title=x<y>A</a>', [("/a", "A", "x<y")], []),
    ('<a href="/no" href="/a" title=1 TITLE="2">A</a>', [("/a", "A", "2")], []),
    ('<a href="/no"href=\'/a?b=1&amp;c="2"\'>A</a>', [('/a?b=1&c="2"', "A", "")], []),
    ('<a title="x > y" href = "/no" href = "/a">A</a>', [("/a", "A", "x > y")], []),
    ('<a href="/no" href>A</a>', [("", "A", "")], []),
    ('<script id=no id=s type=text/x>var a = "<a href=\'/no\'>";</script><a href="/a">1 < 2</a>', [("/a", "1 < 2", "")], [("s", 'var a = "<a href=\'/no\'>";')]),
    ('<a href="/a">A</a><textarea><a href="/no">rest', [("/a", "A", "")], []),
    ('<a href="/a">A</a><p title="<a href=/no', [("/a", "A", "")], []),
    ('<a href="/a">A</a><p x="<" <a href="/b">B</a>', [("/a", "A", "")], []),
]


def read(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "n INT, html STRING")
    both = with_blocks(df, "html").drop("html")
    anchors = explode_anchors(both.drop("scripts")).collect()
    scripts = explode_scripts(both.drop("anchors")).collect()
    by = lambda rows, n: sorted((r for r in rows if r.n == n), key=lambda r: r.pos)
    return [([(r.href, r.text, r.title_attr) for r in by(anchors, n)], [(r.id_lc, r.body) for r in by(scripts, n)]) for n in range(len(pages))]


def test_misread_pages(spark):
    assert read(spark, [p for p, *_ in MISREAD]) == [(a, s) for _, a, s in MISREAD]


def test_plain_form_of_ordinary_pages_reads_the_same(spark):
    """The tokenizer and the patterns agree where the patterns are right, so it does not matter which pages are told."""
    df = spark.createDataFrame(list(enumerate(PAGES)), "n INT, html STRING")
    assert df.where(misread(F.col("html"), visible(F.col("html")))).count() < len(PAGES)
    anew = spark.createDataFrame([(n, written_plainly(p)) for n, p in enumerate(PAGES)], "n INT, html STRING")
    for blocks, rows in ((anchor_blocks, explode_anchors), (script_blocks, explode_scripts)):
        forms = [{tuple(r) for r in rows(x.select("n", blocks(F.col("html")).alias("b")), "b").collect()} for x in (df, anew)]
        assert forms[0] == forms[1]


def built(rnd):
    """A page made from what it holds: text, anchors and scripts between markup that must not count."""
    value = lambda: "".join(rnd.choice(["a", "<", ">", " ", "<a href=/no>", "</a>", "<script>", "<!--", "-->", "=", "/"]) for _ in range(rnd.randint(0, 5)))
    page, anchors, scripts = [], [], []
    for i in range(rnd.randint(1, 8)):
        kind = rnd.randrange(6)
        if kind == 0:
            page.append(f'<p data-x="{value()}" title=\'{value()}\'>t</p>')
        elif kind == 1:
            name = rnd.choice(["textarea", "title", "iframe", "noframes"])
            page.append(f"<{name} x='{value()}'>{value()}</{name}>")
        elif kind == 2:
            title, label = value(), f"l{i}"
            more = rnd.choice(["", ' href="/no"', f' data-x="{value()}"'])
            page.append(f"<a{more} title=\"{title}\" href='/{i}'>{label}</a>")
            anchors.append((f"/{i}", label, title.strip()))
        elif kind == 3:
            body = value().replace("</", "")
            page.append(f"<script id=s{i} data-x=\"{value()}\">{body}</script>")
            scripts.append((f"s{i}", body))
        elif kind == 4:
            page.append(f"<!-- {value().replace('-->', '')} -->")
        else:
            page.append(" 1 < 2 ")
    return "".join(page), anchors, scripts


def test_built_pages(spark):
    rnd = random.Random(3)
    pages = [built(rnd) for _ in range(600)]
    for have, (page, anchors, scripts) in zip(read(spark, [p for p, *_ in pages]), pages, strict=True):
        assert have == (anchors, scripts), page


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a x="<' * 100_000, "<textarea><" * 100_000, "<a href=1 href='" * 50_000, "<a" + " x=<" * 200_000, "<a" + " href=1" * 100_000 + ">",
                                  "</" * 200_000, "<!--" * 200_000, "<title " * 100_000, '<a x="' + "<" * 400_000, "<a " + '"' * 300_000, "<a " + "=" * 300_000, "<a " + "/" * 300_000])
def test_hostile_pages_take_linear_time(spark, page):
    start = time.perf_counter()
    written_plainly(page)
    assert time.perf_counter() - start < 4
    start = time.perf_counter()
    spark.createDataFrame([(page,)], "html STRING").select(misread(F.col("html"), visible(F.col("html")))).collect()
    assert time.perf_counter() - start < 8


def test_control_characters_and_nulls(spark):
    assert read(spark, [None, "", '<a href="/\x01a" title="t\x01&#1;u">A\x01B</a>']) == [([], []), ([], []), ([("/a", "AB", "tu")], [])]
