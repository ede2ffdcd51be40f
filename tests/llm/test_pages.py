"""Operators over pages: archives and main text."""

import io
import random
import time
import zipfile
from collections import Counter

import pytest

from vacantia.llm import archives, extraction

ROWS = [
    (1, "http://a.example/x y\r\n", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example", "é" * 300),
    (4, "http://b.example", ""),
    (5, "http://b.example", None),
    (6, "http://c.example", "<p>one</p>"),
    (6, "http://c.example", "<p>one</p>"),
    (None, "http://d.example", "<p>one</p>"),
    (None, None, "alone"),
    (7, "http://e.example", "z" * 200_000),
]


def facts(rows):
    largest: dict = {}
    for i, _, html in rows:
        html = html or ""
        if i is not None:
            largest[html] = max(largest.get(html, i), i)
    out = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        first = largest.get(html or "")
        revisit = first is not None and (i is None or i < first)
        out[i, len(payload), archives.digest(payload), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "of", "s", 1) for r in ROWS], "page_id long, url string, html string, of string, sha1 string, original int").repartition(2)


@pytest.mark.parametrize("package_bytes", [1 << 30, 100])
def test_archives_round_trip(spark, pages, package_bytes):
    packages = archives.write_packages(pages, archives.package_folder(spark), package_bytes=package_bytes)
    out = archives.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in out.collect()) == facts(ROWS)
    assert packages.count() > 1 and packages.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_one_package_is_read_by_many_tasks(spark, pages):
    packages = archives.write_packages(pages.coalesce(1), archives.package_folder(spark))
    out = archives.read_packages(packages, read_bytes=500)
    assert packages.count() == 1 and out.rdd.getNumPartitions() == -(-packages.first()["bytes"] // 500) > 1
    assert len(out.rdd.glom().filter(len).collect()) > 1 and out.count() == len(ROWS)


def test_archive_of_no_rows(spark, pages):
    assert archives.read_packages(archives.write_packages(pages.where("false"), archives.package_folder(spark))).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_members_are_found_with_and_without_zip64(monkeypatch, wide):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(5):
            z.writestr(f"stored-{i}", bytes([65 + i]) * (40 + i))
        z.writestr("packed", b"a" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"with a comment PK\x05\x06 inside"
    raw = data.getvalue()
    assert (archives.END64 in raw) == wide
    found = archives.members(io.BytesIO(raw), len(raw))
    assert sorted(found) == [f"stored-{i}" for i in range(5)]
    assert all(raw[a : a + n] == bytes([65 + i]) * (40 + i) for i, (a, n) in enumerate(found[f"stored-{k}"] for k in range(5)))


def test_damaged_packages_are_told():
    for raw in (b"", b"no zip at all" * 10, b"PK\x05\x06" + b"\0" * 10):
        with pytest.raises(ValueError):
            archives.members(io.BytesIO(raw), len(raw))


# ---- main text ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="home"><header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><div class="ad">Buy this now, today.</div>
<article><h1>A title</h1><p><b>First   paragraph &amp; more,
 with a <a href="x">link</a>.<br><p>Second one &lt;here&gt;, it goes on and on for a while.</p><div class="ad">Buy more.</div>
<p>Third one&nbsp;ends, after quite a few words.</p></article><aside><p>Related: something else, to read.</p></aside>
<section id="comments"><p>I liked this article, it was a good one.</p></section><form><label>Mail</label><input></form>
<footer>&copy; Site &middot; all rights reserved.</footer></body></html>"""


def test_main_text():
    blocks = extraction.blocks_of(PAGE)
    assert extraction.main_blocks(blocks, extraction.DEFAULT_WEIGHTS) == [
        "A title",
        "First paragraph & more, with a link.",
        "Second one <here>, it goes on and on for a while.",
        "Third one ends, after quite a few words.",
    ]


def test_pages_without_telling_elements():
    text = "This paragraph is long enough, has commas, and ends as sentences do, so it is content. " * 3
    html = f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><div>{text}</div><div>{text}</div><div><a href=c>Imprint</a></div>"
    assert extraction.main_blocks(extraction.blocks_of(html), extraction.DEFAULT_WEIGHTS) == [text.strip()] * 2


LONG = [
    "This paragraph is long enough, has commas, and ends as sentences do, so it is content.",
    "Another paragraph follows, which is as long as the first one, or nearly so, to be sure.",
]


def extracted(html):
    return extraction.main_blocks(extraction.blocks_of(html), extraction.DEFAULT_WEIGHTS)


@pytest.mark.parametrize("name", "plain has-sidebar no-sidebar with-header ad-free post-without-comments sidebar-right siteHeaderLayout".split())
def test_no_article_is_lost_to_a_name_of_its_layout(name):
    html = f'<body class="{name}"><nav><a href=x>Home</a></nav><div class="{name}"><p>{LONG[0]}</p><p>{LONG[1]}</p></div><div class="sidebar">Buy now, it is cheap, in all shops.</div><footer>Imprint</footer>'
    assert extracted(html) == LONG


def test_names_inside_and_beside_an_article():
    note = "Readers should note this, please, and well."
    html = (
        f'<article><p>{LONG[0]}</p><div class="alert"><p>{note}</p></div><section class="notice-of-award"><p>{LONG[1]}</p></section><div class="ad">Buy.</div></article>'
        '<div class="widgetbox"><p>Buy our goods, they are cheap and good, today only, in all shops.</p></div><div class="xyz-b7">Order now, it is cheap.</div>'
    )
    assert extracted(html) == [LONG[0], note, LONG[1]]
    few = f'<div class="ad">{LONG[0]}</div><article><h1>Short.</h1></article>'
    assert extracted(few) == ["Short."]
    comments = f'<div class="text"><p>{LONG[0]}</p></div><div id="comments"><p>{LONG[1]}</p><p>{LONG[1]}</p></div>'
    assert extracted(comments) == [LONG[0]]


HOSTILE = {
    "open tags": "<a " * 60_000, "deep": "<div>x" * 40_000, "quotes": '<a x="' * 60_000, "ends": "<div>" * 20_000 + "</x>" * 60_000 + "</p>" * 20_000, "comments": "<!--" * 60_000,
    "signs": "<" * 200_000, "titles": "<title>" * 60_000, "scripts": "<script>" * 60_000, "lists": "<select>" * 50_000, "values": "<a " + "='" * 60_000,
    "articles": "<article><p>a b c d e, f.</p><nav>x</nav></article>" * 10_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_time_by_their_length(kind):
    begun = time.perf_counter()
    found = extracted(f"<article><p>{LONG[0]}</p>" + HOSTILE[kind])
    assert found[0] == LONG[0] and time.perf_counter() - begun < 10


def test_tags_are_cut_as_browsers_do():
    cut = lambda html: [b.text for b in extraction.blocks_of(html)]
    assert cut('<p title="a > b">One</p><p title=\'>\' x="5" tall">Two <b>bold</b></p>') == ["One", "Two bold"]
    assert cut("a < b <3 c &lt;d&gt; <!-- <p>no</p> --> e<!---->f<!doctype html>g") == ["a < b <3 c <d> ef" + "g"]
    assert cut("<head><title>No</title><body><p>Yes<script>var a='</p>'</script> more") == ["Yes more"]
    assert cut("<title>never ends <p>Text</p>") == ["never ends", "Text"] and cut("<p>Text</p><div class=") == ["Text"]
    assert cut("<DIV>A<Br>b</DIV ><p/>c") == ["A b", "c"]


def test_odd_pages(spark, pages):
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>> <p"), (4, "u", "plain text only"), (5, "u", "<![if x]><p>a</p><![CDATA[b]]>"), (6, "u", PAGE), (6, "u", PAGE), (None, "u", "<article>" + "<p>word</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "t") for r in odd], "page_id long, url string, html string, text string")
    out = extraction.main_text(df).collect()
    assert len(out) == len(odd) and all(r.n_chars == len(r.text) for r in out)
    by_id = {r.page_id: r.text for r in out}
    assert by_id[1] == by_id[2] == "" and by_id[None] == "\n".join(["word"] * 20_000) and by_id[6].startswith("A title\n")
    assert extraction.main_text(df.where("false")).count() == 0


def test_cut_is_minimal():
    """Against all labellings of small graphs."""
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        ties = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in ties if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
        assert cost(extraction.source_side(source, sink, ties)) == best
