"""Checked queries: each is a Spark query of the library and, where SQL can state it, the expected rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import cases as K
from checks import fixtures as X
from checks.fixtures import OPENINGS, sql_text, text
from vacantia.functions import rules as R
from vacantia.functions import vocabulary as V
from vacantia.functions.bind import bind
from vacantia.functions.text import normalize_title, unescape
from vacantia.functions.urls import host, last_segment, normalize_website, path, path_segments, strip_fragment, with_absolute
from vacantia.operators import boards, discover, html, links, listings, scripts
from vacantia.operators.flatten import flatten_records
from vacantia.operators.merge import merge_postings
from vacantia.operators.sinks import COUNTS, write_csv, write_outputs
from vacantia.plans.collect import Collection, collect_jobs, write_jobs
from vacantia.plans.cuts import CutStore
from vacantia.plans.frontier import crawl_frontier
from vacantia.plans.reports import jobs_per_company, run_summary
from vacantia.schemas import job
from vacantia.session import stage, stage_folder, tune
from vacantia.sources import captures, directory, shard_csv
from vacantia.sources.archive import CaptureArchive, capture_changes
from vacantia.sources.published import KINDS, publish_outputs, read_published
from vacantia.streaming import postings as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def literal(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (bool, int)) else sql_text(x)


def cases_sql(cases: list[tuple], columns: list[str]) -> str:
    """DuckDB: every part with its case (part number modulo the number of cases)."""
    arms = []
    for i, name in enumerate(columns):
        whens = " ".join(f"WHEN {n} THEN {literal(c[i])}" for n, c in enumerate(cases))
        arms.append(f"CASE p_partkey % {len(cases)} {whens} END AS {name}")
    return f"SELECT p_partkey AS pk, {', '.join(arms)} FROM (SELECT p_partkey, p_partkey AS pk FROM part)"


def with_cases(spark: SparkSession, sf: str, cases: list[tuple], columns: list[str]) -> DataFrame:
    """Spark: the same, with the given input columns."""
    parts = X.table(spark, sf, "part").select(F.col("p_partkey").alias("pk"))
    at = F.pmod("pk", F.lit(len(cases)))
    cols = {}
    for i, name in enumerate(columns):
        texts = [text(c[i]) if c[i] else F.lit(c[i]) for c in cases]
        cols[name] = F.get(F.array(*texts), at)
    return bind(parts, **cols)


# --- addresses and titles, on the given pages and texts ---------------------------------------------


@query("""
SELECT page_id, split_part(url, '#', 1) AS bare,
  regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\\.', '') AS host,
  '/' || split_part(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/', 2) ||
    '/' || array_to_string(string_split(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/')[3:], '/') AS path,
  len(list_filter(string_split(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/')[2:], lambda x: x <> '')) AS n_segments,
  list_filter(string_split(lower(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1)), '/')[2:], lambda x: x <> '')[-1] AS last
FROM pages
""")
def page_addresses(spark, sf):
    url = F.col("url")
    return X.table(spark, sf, "pages").select(
        "page_id", strip_fragment(url).alias("bare"), host("url").alias("host"), path("url").alias("path"),
        F.size(path_segments(path("url"))).cast("bigint").alias("n_segments"), last_segment(path("url")).alias("last"),
    )


def _pages(spark, sf) -> DataFrame:
    return X.table(spark, sf, "pages").select("page_id", F.col("url").alias("page_url"), "html")


_ANCHORS = """
a AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)<a href="[^"]*">.*?</a>', 0) AS blocks FROM pages),
b AS (SELECT page_id, url, CAST(i - 1 AS INT) AS pos, blocks[i] AS block FROM (SELECT *, unnest(generate_series(1, len(blocks))) AS i FROM a))
"""


@query(f"""
WITH {_ANCHORS}
SELECT page_id, pos, regexp_extract(block, 'href="([^"]*)"', 1) AS href, regexp_extract(block, '(?s)>(.*)</a>', 1) AS text FROM b
""")
def page_anchors(spark, sf):
    pages = _pages(spark, sf).select("page_id", html.anchor_blocks(F.col("html")).alias("anchors"))
    return html.explode_anchors(pages).select("page_id", "pos", "href", "text")


@query(f"""
WITH {_ANCHORS}
SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/]*', 0) || regexp_extract(block, 'href="([^"]*)"', 1) AS target FROM b
""")
def page_link_targets(spark, sf):
    pages = _pages(spark, sf).select("page_id", "page_url", html.anchor_blocks(F.col("html")).alias("anchors"))
    return links.link_targets(html.explode_anchors(pages)).select("page_id", "pos", "target")


@query(f"""
WITH {_ANCHORS}
SELECT page_id, pos + 1 AS pos, regexp_extract(block, 'href="([^"]*)"', 1) AS href, regexp_extract(block, '(?s)>(.*)</a>', 1) AS text, '' AS title FROM b
UNION ALL SELECT page_id, 0, '/p/' || page_id, 'Page', trim(replace(html, '"', ''), ' ' || chr(10) || chr(13) || chr(9)) FROM pages
""")
def misread_page_anchors(spark, sf):
    """Every page behind itself as the text of a form, as a hidden frame, and as the title of a link that has two addresses."""
    title = F.replace(F.replace("html", F.lit('"'), F.lit("")), F.lit("&"), F.lit("&amp;"))
    one = F.concat(F.lit('<a href="/first" title="'), title, F.lit('" href="/p/'), F.col("page_id"), F.lit('">Page</a>'))
    whole = F.concat(F.lit("<textarea>"), "html", F.lit("</textarea><iframe>"), "html", F.lit("</iframe>"), one, "html")
    pages = html.with_blocks(_pages(spark, sf).withColumn("html", whole), "html").select("page_id", "anchors")
    return html.explode_anchors(pages).select("page_id", "pos", "href", "text", F.col("title_attr").alias("title"))


@query("""
SELECT page_id, CAST(0 AS INT) AS pos, '' AS id_lc, '' AS type_lc, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS body
FROM pages WHERE html LIKE '%<script>%'
""")
def page_scripts(spark, sf):
    pages = _pages(spark, sf).select("page_id", html.script_blocks(F.col("html")).alias("scripts"))
    return html.explode_scripts(pages)


@query("""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\\s\\x{00A0}\\x{0085}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS title_md5 FROM documents
""")
def normalized_documents(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.md5(normalize_title(F.col("text"))).alias("title_md5"))


@query("""
SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS title_md5 FROM conversations
""")
def normalized_conversations(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(normalize_title(F.col("text"))).alias("title_md5"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')) AS html_md5 FROM pages")
def decoded_pages(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.md5(unescape("html")).alias("html_md5"))


@query(cases_sql(K.REFERENCES, ["written", "decoded"]))
def character_references(spark, sf):
    df = with_cases(spark, sf, K.REFERENCES, ["written"])
    return df.withColumn("decoded", unescape("written"))


@query(cases_sql(K.JOINS, ["base", "href", "joined"]))
def joined_addresses(spark, sf):
    return with_absolute(with_cases(spark, sf, K.JOINS, ["base", "href"]), "joined", "base", "href")


# --- rules ----------------------------------------------------------------------------------------------


@query(cases_sql(K.JOB_LINKS, ["path", "title", "is_job"]))
def job_link_rule(spark, sf):
    df = with_cases(spark, sf, K.JOB_LINKS, ["path", "title"])
    return df.withColumn("is_job", R.is_job_link(F.lower("path"), F.col("title")))


@query(cases_sql(K.CAREERS_SCORES, ["url", "score"]))
def careers_scores(spark, sf):
    df = bind(with_cases(spark, sf, K.CAREERS_SCORES, ["url"]), root=text("https://acme{pk}.com"))
    df = bind(df, low=F.lower(path("url")), near=R.same_org(host("root"), host("url")))
    return df.select("pk", "url", R.careers_score(F.col("url"), F.col("low"), F.col("near")).alias("score"))


@query(cases_sql(K.HUB_SCORES, ["path", "label", "score"]))
def hub_scores(spark, sf):
    df = with_cases(spark, sf, K.HUB_SCORES, ["path", "label"])
    return df.withColumn("score", R.hub_score(F.lower("path"), F.col("label")))


@query(cases_sql(K.BOARD_URLS, ["url", "vendor", "token"]))
def board_of_address(spark, sf):
    df = bind(with_cases(spark, sf, K.BOARD_URLS, ["url"]), b=R.direct_board(F.col("url")))
    return df.select("pk", "url", "b.vendor", "b.token")


# --- companies ------------------------------------------------------------------------------------------

_SITES = """CASE s_suppkey % 8 WHEN 0 THEN 'co' || s_suppkey || '.com' WHEN 1 THEN 'https://co' || s_suppkey || '.com'
 WHEN 2 THEN ' https://co' || s_suppkey || '.com/a/b?c=d#e ' WHEN 3 THEN 'http://WWW.co' || s_suppkey || '.com:8080/x' WHEN 4 THEN '   '
 WHEN 5 THEN 'https://' WHEN 6 THEN 'co' || s_suppkey || '.com?x' END"""


@query(f"""
SELECT s_suppkey AS k, {_SITES} AS website, CASE s_suppkey % 8 WHEN 3 THEN 'http://WWW.co' || s_suppkey || '.com:8080'
 WHEN 0 THEN 'https://co' || s_suppkey || '.com' WHEN 1 THEN 'https://co' || s_suppkey || '.com'
 WHEN 2 THEN 'https://co' || s_suppkey || '.com' WHEN 6 THEN 'https://co' || s_suppkey || '.com' END AS root FROM supplier
""")
def website_roots(spark, sf):
    df = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.expr(_SITES).alias("website"))
    return df.withColumn("root", normalize_website(F.col("website")))


def _directory_pages(spark, sf):
    """Pages of 100 companies; the page count claims one page less than there is for tables of more than one page."""
    c = X.companies_base(spark, sf)
    hit = X.js(
        slug=F.when(F.expr("k % 9 <> 4"), X.quoted("co-{k}")).otherwise(F.lit('""')), objectID=F.col("k").cast("string"),
        name=F.when(F.expr("k % 5 <> 1"), X.quoted("Company {k}")), website="co{k}.com", batch=F.when(F.expr("k % 3 > 0"), X.quoted("W{k}")),
        isHiring=F.when(F.col("balance") >= 0, "true").otherwise("false"),
    )
    pages = c.select((F.col("k") / 100).cast("int").alias("dir_page"), F.struct("k", hit.alias("x")).alias("h")).groupBy("dir_page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("h")), lambda h: h["x"]), ",").alias("hits")
    )
    return pages.select(
        "dir_page",
        F.concat(F.lit('{"hits":['), "hits", F.lit('],"nbPages":'), F.greatest(F.lit(1), F.lit(c.count() // 100 - 1)).cast("string"), F.lit("}")).alias("body"),
    )


@query("""
SELECT CAST(s_suppkey // 100 AS INT) AS dir_page, CAST(s_suppkey % 100 AS INT) AS pos,
  CASE WHEN s_suppkey % 9 <> 4 THEN 'co-' || s_suppkey ELSE '' END AS slug, CAST(s_suppkey AS VARCHAR) AS object_id,
  CASE WHEN s_suppkey % 5 <> 1 THEN 'Company ' || s_suppkey END AS name, 'co' || s_suppkey || '.com' AS website,
  CASE WHEN s_suppkey % 3 > 0 THEN 'W' || s_suppkey END AS batch, s_acctbal >= 0 AS is_hiring
FROM supplier WHERE s_suppkey // 100 < greatest(1, (SELECT count(*) FROM supplier) // 100 - 1)
""")
def directory_companies(spark, sf):
    return directory.companies_from_pages(_directory_pages(spark, sf))


@query("""
SELECT s_suppkey AS dir_page, CASE s_suppkey % 7 WHEN 3 THEN 'directory page is malformed' ELSE 'directory page was not captured' END AS fault, CAST(NULL AS VARCHAR) AS slug
FROM supplier WHERE s_suppkey % 7 IN (3, 5) UNION ALL SELECT s_suppkey, NULL, 'co-' || s_suppkey FROM supplier WHERE s_suppkey % 7 NOT IN (3, 5)
""")
def directory_faults(spark, sf):
    """Malformed and missing pages do not end the walk, and are told."""
    c = X.table(spark, sf, "supplier")
    pages = F.lit(c.count()).cast("string")
    c = c.where("s_suppkey % 7 <> 5").select(F.col("s_suppkey").alias("dir_page"))
    body = F.concat(F.lit('{"hits":[{"slug":"co-'), F.col("dir_page").cast("string"), F.lit('"}],"nbPages":'), pages, F.when(F.expr("dir_page % 7 <> 3"), "}").otherwise(""))
    pages = directory.parsed_pages(c.select("dir_page", body.alias("body")))
    faults = directory.directory_faults(pages).select("dir_page", "fault", F.lit(None).cast("string").alias("slug"))
    return faults.unionByName(directory.companies_from_hits(pages).select("dir_page", F.lit(None).cast("string").alias("fault"), "slug"))


_SHARD = "CAST(('0x' || substr(sha256({key}), 1, 16))::UBIGINT % {n} AS INT)"


@query(f"""
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 4 THEN CAST(s_suppkey AS VARCHAR) ELSE 'co-' || s_suppkey END AS key FROM supplier)
SELECT k, CAST(0 AS INT) AS of_1, {_SHARD.format(key='key', n=4)} AS of_4, {_SHARD.format(key='key', n=7)} AS of_7 FROM s
""")
def company_shards(spark, sf):
    df = X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.when(F.expr("s_suppkey % 9 <> 4"), F.concat(F.lit("co-"), "s_suppkey")).otherwise("").alias("slug"),
        F.col("s_suppkey").cast("string").alias("object_id"),
    )
    key = directory.shard_key()
    return df.select("k", *[R.shard_index(key, n).alias(f"of_{n}") for n in (1, 4, 7)])


@query(f"""
WITH s AS (SELECT *, {_SHARD.format(key="'co-' || s_suppkey", n=4)} AS shard FROM supplier WHERE s_acctbal >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY s_suppkey) AS n FROM s)
SELECT 'co-' || s_suppkey AS slug, shard FROM r WHERE n <= 5
""")
def first_companies_per_shard(spark, sf):
    c = X.archive_companies(spark, sf)
    return directory.select_companies(c, max_companies=5, num_shards=4, limit_per_shard=True).select("slug", "shard")


@query(f"""
SELECT 'co-' || s_suppkey AS slug, {_SHARD.format(key="'co-' || s_suppkey", n=4)} AS shard FROM supplier
WHERE {_SHARD.format(key="'co-' || s_suppkey", n=4)} = 2 ORDER BY s_suppkey LIMIT 7
""")
def first_companies_of_one_shard(spark, sf):
    c = X.archive_companies(spark, sf)
    return directory.select_companies(c, only_hiring=False, max_companies=7, num_shards=4, shard=2).select("slug", "shard")


# --- payloads -------------------------------------------------------------------------------------------


def _payload_rows(rows: DataFrame, url: str) -> DataFrame:
    payload = boards.board_payloads(X.response(rows, url, F.col("body"), content_type="application/json"))
    return boards.board_postings(payload).select("request_url", "board_pos", "job.*").drop("type", "salary_range")


_POS = "CAST(row_number() OVER (PARTITION BY k ORDER BY pk) - 1 AS INT) AS board_pos"


@query(OPENINGS + f"""
SELECT 'https://boards-api.greenhouse.io/v1/boards/gh' || k || '/jobs?content=true' AS request_url, {_POS}, 'greenhouse' AS source, title,
  'https://co' || k || '.example.com/jobs/' || pk AS url, CASE WHEN sz % 2 = 0 THEN nation ELSE region END AS location, CAST(NULL AS VARCHAR) AS apply_url FROM o
""")
def greenhouse_jobs(spark, sf):
    return _payload_rows(X.greenhouse_jobs(X.openings(spark, sf)), X.api(X.GH_API, "gh{k}"))


@query(OPENINGS + f"""
SELECT 'https://api.lever.co/v0/postings/lv' || k || '?mode=json' AS request_url, {_POS}, 'lever' AS source, title,
  'https://jobs.lever.co/lv' || k || '/' || pk || CASE WHEN sz % 5 = 0 THEN '/apply' ELSE '' END AS url,
  CASE WHEN sz % 7 = 0 THEN NULL WHEN sz % 3 = 0 THEN nation || ', ' || region ELSE nation END AS location, CAST(NULL AS VARCHAR) AS apply_url FROM o
""")
def lever_jobs(spark, sf):
    return _payload_rows(X.lever_jobs(X.openings(spark, sf)), X.api(X.LEVER_API, "lv{k}"))


@query("SELECT * EXCLUDE (sz) FROM (" + OPENINGS + f"""
SELECT 'https://api.ashbyhq.com/posting-api/job-board/ab' || k || '?includeCompensation=false' AS request_url, {_POS}, 'ashby' AS source, title,
  'https://jobs.ashbyhq.com/ab' || k || '/' || pk AS url, nation AS location, 'https://jobs.ashbyhq.com/ab' || k || '/' || pk || '/application' AS apply_url, sz FROM o
) WHERE sz % 4 <> 0""")
def ashby_jobs(spark, sf):
    return _payload_rows(X.ashby_jobs(X.openings(spark, sf)), X.api(X.ASHBY_API, "ab{k}"))


_FAULT_KINDS = """CASE s_suppkey % 9 WHEN 0 THEN '{"jobs":[' WHEN 1 THEN '[]' WHEN 2 THEN '{"jobs":{"a":1}}' WHEN 3 THEN '{"jobs":[7]}'
 WHEN 4 THEN '{"jobs":null}' WHEN 5 THEN '{}' WHEN 6 THEN 'oops' WHEN 7 THEN '{"jobs":[{"title":"x"}]}' ELSE '{"jobs":[{}]} 1' END"""


@query("""
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN 'timed out' WHEN s_suppkey % 7 = 0 THEN NULL ELSE CASE s_suppkey % 9
  WHEN 0 THEN 'greenhouse: payload is not valid JSON' WHEN 1 THEN 'greenhouse: payload root is not an object'
  WHEN 2 THEN 'greenhouse: jobs is not a list' WHEN 3 THEN 'greenhouse: broken entry in the job list'
  WHEN 6 THEN 'greenhouse: payload is not valid JSON' WHEN 8 THEN 'greenhouse: payload is not valid JSON' END END AS fault,
  CASE WHEN s_suppkey % 9 = 7 AND s_suppkey % 11 > 0 AND s_suppkey % 7 > 0 THEN 1 ELSE 0 END AS n_jobs FROM supplier
""")
def payload_faults(spark, sf):
    """Broken payloads are faults; a status other than 200 is just empty."""
    rows = X.table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey"))
    captured = X.response(
        rows, X.api(X.GH_API, "{k}"), F.expr(_FAULT_KINDS), status=F.expr("CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END"),
        error=F.expr("CASE WHEN k % 11 = 0 THEN 'timed out' END"),
    )
    return boards.board_payloads(captured).select(
        F.regexp_extract("request_url", r"boards/(\d+)/", 1).cast("bigint").alias("k"), "fault",
        F.greatest(F.coalesce(F.size("jobs"), F.lit(0)), F.lit(0)).alias("n_jobs"),
    )


# --- scripts --------------------------------------------------------------------------------------------


def _script_table(rows: DataFrame, body, kind: str = "", name: str = "") -> DataFrame:
    # Bound, so that no filter on a long text moves to the few tasks that read the rows it is made of.
    table = rows.withColumn("page_url", text("https://co{k}.example.com/careers"))
    return bind(table, body=body).select(
        "pk", "page_url", F.lit(0).alias("pos"), F.lit(name).alias("id_lc"), F.lit(kind).alias("type_lc"), "body",
    )


@query(OPENINGS + """
SELECT pk, CAST(CASE WHEN pk % 6 = 3 THEN 1 ELSE 0 END AS INT) AS walk_pos, title,
  CASE pk % 5 WHEN 0 THEN 'https://co' || k || '.example.com/careers/jobs/' || pk WHEN 1 THEN 'https://j.org/' || pk
    WHEN 2 THEN 'https://co' || k || '.example.com/jobs/' || pk || '#x' WHEN 3 THEN 'http://list.org/' || pk END AS url,
  CASE sz % 5 WHEN 0 THEN nation || ', ' || region WHEN 1 THEN nation WHEN 2 THEN region END AS location
FROM o WHERE pk % 6 <> 5 AND pk % 7 <> 0
""")
def linked_data_jobs(spark, sf):
    """Object, list, graph before its owner, typed list; broken scripts and other types give nothing."""
    o = X.openings(spark, sf)
    url = F.expr("CASE pk % 5 WHEN 0 THEN concat('\"jobs/', pk, '\"') WHEN 1 THEN concat('\" https://j.org/', pk, '#frag \"')"
                 " WHEN 2 THEN concat('\"/jobs/', pk, '#x\"') WHEN 3 THEN concat('[7,\"x\",\"http://list.org/', pk, '\"]') END")
    url = F.when(F.expr("pk % 5 = 0"), X.quoted("https://co{k}.example.com/careers/jobs/{pk}#f")).otherwise(url)
    place = F.expr("""CASE sz % 5 WHEN 0 THEN concat('{"address":{"addressLocality":"', nation, '","addressRegion":"","addressCountry":"', region, '"}}')
        WHEN 1 THEN concat('{"address":"', nation, '"}') WHEN 2 THEN concat('[{"address":{"addressRegion":"', region, '"}},{"address":"x"}]')
        WHEN 3 THEN '[{"address":"x"}]' END""")
    kind = F.expr("CASE WHEN pk % 7 = 0 THEN '\"Posting\"' WHEN pk % 2 = 0 THEN '\"JobPosting\"' ELSE '[1,\"Thing\",\"JobPosting\"]' END")
    posting = X.js(**{"@type": kind, "title": " {title} ", "sameAs": F.when(F.expr("pk % 5 = 3"), url), "url": F.when(F.expr("pk % 5 <> 3"), url), "jobLocation": place})
    other = F.lit('{"@type":"Organization","title":"x","member":{"@type":"JobPosting","title":"no"}}')
    body = (
        F.when(F.expr("pk % 6 = 0"), posting).when(F.expr("pk % 6 = 1"), F.concat(F.lit("\n[["), posting, F.lit("]]")))
        .when(F.expr("pk % 6 = 2"), F.concat(F.lit('{"@type":"WebPage","@graph":['), posting, F.lit(","), other, F.lit("]}")))
        .when(F.expr("pk % 6 = 3"), F.concat(F.lit("["), other, F.lit(',{"@graph":'), posting, F.lit("}]")))
        .when(F.expr("pk % 6 = 4"), posting).otherwise(F.concat(posting, F.lit("}")))
    )
    found = scripts.linked_data_postings(_script_table(o, body, "application/ld+json; charset=utf-8"))
    return found.select("pk", "walk_pos", "job.title", "job.url", "job.location")


@query(OPENINGS + """
SELECT pk, title, CASE WHEN pk % 9 IN (7, 8) AND sz % 3 = 0 THEN 'https://apply.org/' || pk WHEN pk % 9 = 7 THEN 'https://x.org/job/' || pk WHEN pk % 9 = 8 THEN 'https://co' || k || '.example.com/r/' || pk
    ELSE 'https://b.org/' || pk END AS url,
  CASE sz % 4 WHEN 0 THEN nation WHEN 1 THEN nation || ', ' || region WHEN 2 THEN region END AS location,
  CASE WHEN pk % 9 IN (5, 6) THEN 'https://b.org/' || pk WHEN sz % 3 = 0 THEN 'https://apply.org/' || pk END AS apply_url
FROM o WHERE pk % 11 NOT IN (0, 1, 2, 3, 4)
""")
def embedded_jobs(spark, sf):
    """Any depth, any accepted address key; blocked, short and non-text titles and hintless objects give nothing."""
    o = X.openings(spark, sf)
    key = F.expr("element_at(array('absolute_url','hostedUrl','hosted_url','jobUrl','public_url','applyUrl','apply_url','url','url'), CAST(pk % 9 + 1 AS INT))")
    url = F.expr("CASE WHEN pk % 9 = 7 THEN concat('https://x.org/job/', pk, '#z') WHEN pk % 9 = 8 THEN concat('/r/', pk, '#z') ELSE concat(' https://b.org/', pk, '#z') END")
    title = F.expr("CASE pk % 11 WHEN 0 THEN '\"View All Jobs\"' WHEN 1 THEN '\" x \"' WHEN 2 THEN '[\"Engineer\"]' WHEN 3 THEN NULL ELSE concat('\" ', title, '\"') END")
    name = F.expr("CASE pk % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'text' ELSE 'jobTitle' END")
    place = F.expr("""CASE sz % 4 WHEN 0 THEN concat('{"name":"', nation, '"}') WHEN 1 THEN concat('{"name":"","address":{"addressLocality":"', nation, '","addressCountry":"', region, '"}}')
        WHEN 2 THEN concat('"', region, '"') ELSE '["x"]' END""")
    fields = F.concat_ws(
        ",", F.concat(F.lit('"'), name, F.lit('":'), title), F.concat(F.lit('"'), key, F.lit('":"'), url, F.lit('"')),
        F.concat(F.when(F.expr("sz % 2 = 0"), '"location":').otherwise('"jobLocation":'), place),
        F.when(F.expr("sz % 3 = 0 AND pk % 9 NOT IN (5, 6)"), X.js(applyUrl=F.lit("0")).substr(F.lit(2), F.lit(12))),
        F.when(F.expr("sz % 3 = 0 AND pk % 9 NOT IN (5, 6)"), F.concat(F.lit('"apply_url":"'), text("https://apply.org/{pk}#y"), F.lit('"'))),
        F.when(F.expr("pk % 11 <> 4"), F.lit('"Updated_At":null')).otherwise(F.lit('"other":1')),
    )
    # The address keys themselves are hints, so hintless objects need a key that is none.
    fields = F.when(F.expr("pk % 11 = 4"), F.concat(F.lit('"title":"Engineer","public_url":"https://b.org/1","x":'), F.lit("1"))).otherwise(fields)
    open_, close = F.expr("repeat('{\"a\":[1,', CAST(sz % 6 AS INT))"), F.expr("repeat(']}', CAST(sz % 6 AS INT))")
    body = F.concat(open_, F.lit('{"pad":"........................",'), fields, F.lit("}"), close)
    return scripts.embedded_postings(_script_table(o, body, "application/json")).select("pk", "job.title", "job.url", "job.location", "job.apply_url")


@query("SELECT s_suppkey AS k, 'Engineer ' || s_suppkey AS title, n AS walk_pos FROM supplier, (VALUES (0), (1)) v(n)")
def long_embedded_scripts(spark, sf):
    """A script of over 90,000 values is read to its end."""
    c = X.spread(X.companies_base(spark, sf), "k")
    k = F.col("k").cast("string")
    item = F.concat(F.lit('{"title":"Engineer '), k, F.lit('","jobUrl":"https://b.org/'), k, F.lit("/"))
    body = F.concat(F.lit("["), F.expr("repeat('0,', 90000)"), item, F.lit('1"},[['), item, F.lit('2"}]]]'))
    found = scripts.embedded_postings(_script_table(c.withColumn("pk", F.col("k")), body, "application/json"))
    return found.select(F.col("pk").alias("k"), "job.title", "walk_pos")


@query(OPENINGS + "SELECT pk, title, 'https://b.org/' || pk AS url, linked FROM o, (VALUES (true), (false)) v(linked) WHERE pk % 4 <> 3")
def hostile_scripts(spark, sf):
    """Half a surrogate pair, numbers out of range and nesting no reader follows lose nothing; broken texts give nothing."""
    o = X.spread(X.openings(spark, sf), "pk")
    extra = (
        F.when(F.expr("pk % 4 = 0"), F.lit('"note":"\\ud83d","location":"\\ud83d"')).when(F.expr("pk % 4 = 1"), F.lit('"location":1e999,"job_id":-1e999,"size":' + "9" * 400))
        .when(F.expr("pk % 4 = 2"), F.concat(F.lit('"location":'), F.expr("repeat('[', 3000)"), F.expr("repeat(']', 3000)"))).otherwise(F.lit('"x":"\\u12"'))
    )
    address = text("https://b.org/{pk}")
    head = F.concat(F.lit('{"@type":"JobPosting","title":"'), "title", F.lit('","hostedUrl":"'), address, F.lit('","url":"'), address, F.lit('",'))
    posting = F.concat(head, extra, F.lit("}"))
    found = None
    for linked in (True, False):
        table = _script_table(o, posting, "application/ld+json" if linked else "application/json")
        df = scripts.linked_data_postings(table) if linked else scripts.embedded_postings(table)
        df = df.select("pk", "job.title", "job.url", F.lit(linked).alias("linked"))
        found = df if found is None else found.unionByName(df)
    return found


@query(OPENINGS + """
SELECT pk, linked, CASE WHEN linked THEN repeat('7', 60) || pk ELSE title END AS title, 'https://b.org/' || pk AS url, nation || ', ' || region AS location
FROM o, (VALUES (true), (false)) v(linked)
""")
def deep_scripts(spark, sf):
    """Postings below 220 levels with ids of 5,000 digits, and locations with 600 levels behind what is read of them."""
    o = X.spread(X.openings(spark, sf), "pk")
    place = X.js(addressLocality="{nation}", addressCountry="{region}")
    location = F.concat(F.lit('{"address":'), place, F.lit(',"x":'), F.expr("repeat('[', 600)"), F.expr("repeat(']', 600)"), F.lit("}"))
    found = None
    for linked in (True, False):
        name = F.concat(F.lit("7" * 60), text("{pk}")) if linked else X.quoted("{title}")
        posting = X.js(**{"@type": "JobPosting", "title": name, "job_id": F.lit("9" * 5000), "url" if linked else "jobUrl": "https://b.org/{pk}", "jobLocation": location})
        nested = F.concat(F.expr("repeat('[', 220)"), posting, F.expr("repeat(']', 220)"))
        table = _script_table(o, nested, "application/ld+json" if linked else "application/json")
        df = scripts.linked_data_postings(table) if linked else scripts.embedded_postings(table)
        df = df.select("pk", F.lit(linked).alias("linked"), "job.title", "job.url", "job.location")
        found = df if found is None else found.unionByName(df)
    return found


@query(OPENINGS + """SELECT pk, CASE pk % 8 WHEN 0 THEN 'next' WHEN 1 THEN 'json' WHEN 3 THEN 'json' WHEN 7 THEN 'bundle' END AS kept FROM o WHERE pk % 8 IN (0, 1, 3, 7)""")
def embedded_script_choice(spark, sf):
    o = X.openings(spark, sf)
    bundle = F.expr("CASE WHEN pk % 3 = 0 THEN 'x = {absolute_url: 1, Greenhouse' ELSE rpad('x = {absolute_url: 1, Greenhouse', 4001, ' ') END")
    df = o.select(
        "pk", F.lit(0).alias("pos"),
        F.expr("CASE pk % 8 WHEN 0 THEN '__next_data__' WHEN 2 THEN '__next_data__' ELSE '' END").alias("id_lc"),
        F.expr("CASE pk % 8 WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/ld+json' WHEN 3 THEN 'application/json' WHEN 4 THEN 'text/javascript' WHEN 5 THEN 'module' WHEN 7 THEN 'text/javascript' ELSE '' END").alias("type_lc"),
        F.when(F.expr("pk % 8 IN (0, 1, 2, 6)"), F.when(F.expr("pk % 8 = 6"), F.lit("absolute-url greenhouse")).otherwise(F.lit('{"a":"absolute_url greenhouse"}'))).when(F.expr("pk % 8 = 3"), F.lit('   {"a":"12345678"}        '))
        .when(F.expr("pk % 8 IN (5, 7)"), bundle).otherwise(F.expr("rpad('absolute_url', 4001, ' ')")).alias("body"),
    )
    return scripts.embedded_scripts(df).select("pk", F.when(F.col("id_lc") != "", "next").when(F.col("type_lc") == "application/json", "json").otherwise("bundle").alias("kept"))


# --- links of a page ------------------------------------------------------------------------------------


@query(OPENINGS + """
SELECT k, 'Role ' || title AS title, 'https://co' || k || '.example.com/jobs/' || pk AS url FROM o WHERE pk % 6 <= 3
UNION ALL SELECT k, title, 'https://jobs.lever.co/lv' || k || '/jobs/' || pk FROM o WHERE pk % 6 = 4
UNION ALL SELECT k, rtrim(repeat('long ', 50)), 'https://co' || k || '.example.com/jobs/' || pk FROM o WHERE pk % 6 = 5
""")
def page_job_links(spark, sf):
    """Forms of the same link; repeats after the first accepted one, other sites and unusable links give nothing."""
    o = X.openings(spark, sf)
    form = F.when(F.expr("pk % 6 = 0"), text('<a href="/jobs/{pk}">Role\n <b>{title}</b></a>'))
    form = form.when(F.expr("pk % 6 = 1"), text("<A class=x HREF='https://www.co{k}.example.com/../jobs/{pk}'>&nbsp;</A><A data-href='/q' Href = 'jobs/../../jobs/{pk}#a'>Role {title}</A>"))
    form = form.when(F.expr("pk % 6 = 2"), text('<a href=/jobs/{pk}>Role {title}</a><a href="/jobs/{pk}">Again {title}</a>'))
    form = form.when(F.expr("pk % 6 = 3"), text('<a href="  "></a><a href="#top">Top of jobs</a><a name="z">Z</a><a href="&#47;jobs&#x2F;{pk}" title="a>b">Role <!-- x -->{title}</a>'))
    form = form.when(F.expr("pk % 6 = 4"), text('<a href="https://jobs.lever.co/lv{k}/jobs/{pk}">{title}</a><a href="https://else.org/jobs/{pk}">{title}</a>'))
    form = form.otherwise(F.concat(text('<a href="/jobs/{pk}">'), F.lit("long " * 50), F.lit("</a>")))
    body = X.per_company(o, form, "\n")
    captured = X.response(body, "https://co{k}.example.com/careers", X.html(F.col("body")))
    parts = html.page_parts(captures.page_captures(captured))
    found = links.link_postings(links.link_facts(parts)).select("page_url", "script_pos", "extractor", "walk_pos", "job")
    merged = merge_postings(found, ["page_url"], order=["extractor", "script_pos"])
    return merged.select(F.regexp_extract("page_url", r"co(\d+)\.", 1).cast("bigint").alias("k"), "job.title", "job.url")


@query(OPENINGS + """
SELECT k, vendor_rank, vendor, token FROM (
  SELECT k, CAST(0 AS INT) AS vendor_rank, 'greenhouse' AS vendor, 'gh_' || pk AS token FROM o WHERE pk % 4 = 0
  UNION ALL SELECT k, 1, 'lever', 'Lv-' || pk FROM o WHERE pk % 4 = 1
  UNION ALL SELECT k, 2, 'ashby', 'ab' || pk FROM o WHERE pk % 4 = 2)
""")
def page_board_tokens(spark, sf):
    o = X.openings(spark, sf)
    form = (
        F.when(F.expr("pk % 4 = 0"), text('<script src="https://boards.greenhouse.io/gh_{pk}/embed.js"></script><i>http://BOARDS.greenhouse.io/gh_{pk}</i>'))
        .when(F.expr("pk % 4 = 1"), text('<a href="https://jobs.lever.co/Lv-{pk}?x">x</a> https://jobs.lever.co/a jobs.lever.co/no{pk}'))
        .when(F.expr("pk % 4 = 2"), text("https://www.jobs.ashbyhq.com/ab{pk}/1 https://jobs.ashbyhq.com/Embed"))
        .otherwise(text("https://job-boards.greenhouse.io/zz{pk}"))
    )
    pages = X.per_company(o, form, "\n")
    return pages.select("k", F.inline(html.board_tokens(F.col("body"))))


def _hub_rows():
    """(href, label, score) per link of the hub fixture, in page order."""
    return [
        ("/a{n}", "Hello", 0), ("/open-roles", "Stuff", 300), ("/x/b", "Join our team", 400), ("/jobs", "Read", 300), ("/x/b", "Open roles", 400),
        ("/careers/list", "See all jobs", 450), ("mailto:open@positions.org", "Open positions", 0), ("/jobs", "View jobs", 500),
        ("https://else.org/jobs", "View jobs", 0), ("/roles", "Z", 300), ("/vacancies", "Z", 300), ("/opportunities", "Z", 300), ("/job-board", "Z", 300),
        ("/listings/", "Z", 300), ("https://boards.greenhouse.io/x/open-positions", "Z", 300),
    ]


@query("""
WITH hub(hub_url, hub_score, hub_rank) AS (VALUES ('/jobs', 500, 1), ('/careers/list', 450, 2), ('/x/b', 400, 3), ('/open-roles', 300, 4),
  ('/roles', 300, 5), ('/vacancies', 300, 6), ('/opportunities', 300, 7), ('/job-board', 300, 8), ('/listings/', 300, 9), ('https://boards.greenhouse.io/x/open-positions', 300, 10))
SELECT s_suppkey AS k, CASE WHEN hub_url LIKE '/%' THEN 'https://co' || s_suppkey || '.example.com' ELSE '' END || hub_url AS hub_url, hub_score, hub_rank FROM supplier, hub
""")
def hub_ranking(spark, sf):
    c = X.companies_base(spark, sf)
    rows = "".join(f'<a href="{h.replace("{n}", "1")}" {"title" if i % 2 else "aria-label"}="{t}"><img></a>' for i, (h, t, _) in enumerate(_hub_rows()))
    captured = X.response(c, "https://co{k}.example.com/careers", X.html(F.lit(rows)))
    facts = links.link_facts(html.page_parts(captures.page_captures(captured)))
    return discover.rank_hubs(facts).select(F.regexp_extract("request_url", r"co(\d+)\.", 1).cast("bigint").alias("k"), "hub_url", "hub_score", "hub_rank")


@query(OPENINGS + """
, x AS (SELECT k, pk, title, CAST(row_number() OVER (PARTITION BY k ORDER BY pk) % 3 AS INT) AS page, CASE WHEN sz % 3 = 0 THEN '' ELSE 'https://j.org/' || (pk % 7) END AS url, sz FROM o),
y AS (SELECT k, page, 1 AS ext, pk, title, url, 'embedded_json' AS source FROM x UNION ALL SELECT k, page, 3, pk, 'L ' || title, url, 'html_link' FROM x WHERE url <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY k, CASE WHEN url <> '' THEN url ELSE source || ':' || title END ORDER BY page, ext, pk) AS n FROM y)
SELECT k, source, title, url FROM z WHERE n = 1
""")
def first_wins_merge(spark, sf):
    from pyspark.sql.window import Window

    o = X.openings(spark, sf)
    x = o.select(
        "k", "pk", "title", (F.row_number().over(Window.partitionBy("k").orderBy("pk")) % 3).cast("int").alias("page_rank"),
        F.when(F.expr("sz % 3 = 0"), "").otherwise(F.concat(F.lit("https://j.org/"), (F.col("pk") % 7).cast("string"))).alias("url"),
    )
    pad = [F.lit(0).alias("script_pos"), F.lit("").alias("token"), F.col("pk").cast("int").alias("walk_pos")]
    embedded = x.select("k", "page_rank", F.lit(1).alias("extractor"), *pad, job(source=F.lit("embedded_json"), title=F.col("title"), url=F.concat(F.lit(" "), "url")).alias("job"))
    link = x.where("url <> ''").select("k", "page_rank", F.lit(3).alias("extractor"), *pad, job(source=F.lit("html_link"), title=F.concat(F.lit("L "), "title"), url=F.col("url")).alias("job"))
    merged = merge_postings(embedded.unionByName(link), ["k"])
    return merged.select("k", "job.source", "job.title", F.trim("job.url").alias("url"))


# --- the archive ----------------------------------------------------------------------------------------

_made: dict[tuple, object] = {}


def archive(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Companies and captured responses, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf, "archive")
    if key not in _made:
        responses = stage(X.archive_responses(spark, sf), "archive")
        _made[key] = (X.archive_companies(spark, sf), responses)
    return _made[key]


def collection(spark: SparkSession, sf: str, render: str = "http") -> Collection:
    """A run over the archive, shared by the queries that look at its steps."""
    key = (spark.sparkContext.applicationId, sf, render)
    if key not in _made:
        _made[key] = Collection(*archive(spark, sf), render=render)
    return _made[key]


def forget_runs() -> None:
    """Let the next query on a run make its tables anew; the archive stays."""
    for key in [k for k in _made if k[2] != "archive"]:
        _made.pop(key).close()


_SITE = "'https://co' || k || '.example.com'"


@query(f"""
SELECT {_SITE.replace('k', 's_suppkey', 1)} AS root, CAST(CASE WHEN kind IN (0, 1, 2, 8) THEN 1 WHEN kind IN (3, 4, 6, 9) THEN 2 WHEN kind = 5 THEN 3 END AS INT) AS tier,
  CASE kind WHEN 0 THEN 'https://boards.greenhouse.io/gh' || s_suppkey WHEN 8 THEN 'https://boards.greenhouse.io/gh' || s_suppkey
    WHEN 1 THEN 'https://jobs.lever.co/lv' || s_suppkey || '/' WHEN 2 THEN 'https://jobs.ashbyhq.com/ab' || s_suppkey || '?x=1'
    WHEN 3 THEN 'https://co' || s_suppkey || '.example.com/careers/' WHEN 4 THEN 'https://co' || s_suppkey || '.example.com/jobs'
    WHEN 5 THEN 'https://co' || s_suppkey || '.example.com/company/jobs' WHEN 6 THEN 'https://co' || s_suppkey || '.example.com/careers'
    WHEN 9 THEN 'https://co' || s_suppkey || '.example.com/careers' END AS careers_url
FROM (SELECT *, s_suppkey % 10 AS kind FROM supplier) WHERE s_suppkey % 20 <> 17
""")
def careers_pages(spark, sf):
    return collection(spark, sf).discovered


@query(f"""
SELECT 'https://co' || s_suppkey || '.example.com' || page AS careers_url, CAST(page_rank AS INT) AS page_rank, 'https://co' || s_suppkey || '.example.com' || wanted AS wanted_url, has_text
FROM supplier JOIN (VALUES (3, '/careers/', 0, '/careers/', true), (4, '/jobs', 0, '/jobs', true), (5, '/company/jobs', 0, '/company/jobs', true),
  (5, '/company/jobs', 1, '/open-positions', true), (6, '/careers', 0, '/careers', true), (9, '/careers', 0, '/careers', true)) v(kind, page, page_rank, wanted, has_text) ON s_suppkey % 10 = kind
""")
def visited_pages(spark, sf):
    return collection(spark, sf).passes[0].visits.select("careers_url", "page_rank", "wanted_url", "has_text")


@query(OPENINGS + """
SELECT 'https://co' || c.k || '.example.com/careers' AS careers_url, t.token AS token, CAST(NULL AS VARCHAR) AS fault, CAST(CASE WHEN t.token = 'none' THEN 0 ELSE n END AS BIGINT) AS n_jobs
FROM c JOIN (SELECT k, count(*) FILTER (sz % 2 = 0) AS n FROM o GROUP BY k) x ON x.k = c.k, LATERAL (SELECT unnest(['gh' || c.k, 'none']) AS token) t WHERE c.k % 10 = 6
""")
def boards_named_in_pages(spark, sf):
    run = collection(spark, sf)
    return run.passes[0].boards.join(run.payloads.select("request_url", "jobs"), "request_url", "left").select(
        "careers_url", "token", "fault", F.greatest(F.coalesce(F.size("jobs"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_jobs")
    )


_COMPANY_COLUMNS = """'Company ' || k AS company_name, 'co-' || k AS company_slug, CASE WHEN k % 3 = 0 THEN NULL ELSE 'W' || (k % 3) END AS batch,
  CASE WHEN k % 20 <> 17 THEN 'co' || k || '.example.com/?utm=1' END AS website"""

# Expected careers postings of the archive, without notes and errors.
_POSTINGS = """
j AS (
  SELECT k, title, CASE WHEN sz % 2 = 0 THEN nation ELSE region END AS location, 'https://co' || k || '.example.com/jobs/' || pk AS job_url, '' AS apply_url,
    'https://boards.greenhouse.io/gh' || k AS careers_url, 'greenhouse' AS job_source FROM o WHERE k % 10 = 0
  UNION ALL SELECT k, title, CASE WHEN sz % 7 = 0 THEN '' WHEN sz % 3 = 0 THEN nation || ', ' || region ELSE nation END,
    'https://jobs.lever.co/lv' || k || '/' || pk || CASE WHEN sz % 5 = 0 THEN '/apply' ELSE '' END, '', 'https://jobs.lever.co/lv' || k || '/', 'lever' FROM o WHERE k % 10 = 1
  UNION ALL SELECT k, title, nation, 'https://jobs.ashbyhq.com/ab' || k || '/' || pk, 'https://jobs.ashbyhq.com/ab' || k || '/' || pk || '/application',
    'https://jobs.ashbyhq.com/ab' || k || '?x=1', 'ashby' FROM o WHERE k % 10 = 2 AND sz % 4 <> 0
  UNION ALL SELECT k, title, nation || ', ' || region, 'https://co' || k || '.example.com/jobs/' || pk, '', 'https://co' || k || '.example.com/careers/', 'json_ld' FROM o WHERE k % 10 = 3 AND pk % 3 < 2
  UNION ALL SELECT DISTINCT k, title, nation || ', ' || region, '', '', 'https://co' || k || '.example.com/careers/', 'json_ld' FROM o WHERE k % 10 = 3 AND pk % 3 = 2
  UNION ALL SELECT k, title, nation, 'https://co' || k || '.example.com/roles/' || pk, '', 'https://co' || k || '.example.com/jobs', 'embedded_json' FROM o WHERE k % 10 = 4
  UNION ALL SELECT k, CASE WHEN sz % 2 = 0 THEN title ELSE 'X ' || title END, '', 'https://co' || k || '.example.com/jobs/' || pk, '', 'https://co' || k || '.example.com/company/jobs', 'html_link' FROM o WHERE k % 10 = 5
  UNION ALL SELECT k, CASE WHEN sz % 2 = 0 THEN title ELSE 'X ' || title END, CASE WHEN sz % 2 = 0 THEN nation ELSE '' END, 'https://co' || k || '.example.com/jobs/' || pk, '',
    'https://co' || k || '.example.com/careers', CASE WHEN sz % 2 = 0 THEN 'greenhouse' ELSE 'html_link' END FROM o WHERE k % 10 = 6
)"""
_RENDERED = """SELECT k, title, '' AS location, 'https://co' || k || '.example.com/jobs/' || pk AS job_url, '' AS apply_url,
  'https://co' || k || '.example.com/careers?r=1' AS careers_url, 'html_link' AS job_source FROM o WHERE k % 10 = 9"""
_FLAT_CAREERS = f"""SELECT 'company_careers' AS source, {_COMPANY_COLUMNS}, title AS job_title, location, job_url, apply_url, careers_url,
  '' AS salary_range, '' AS job_type, job_source, '' AS stage, '' AS error"""
_FLAT_ERROR = f"""SELECT 'error' AS source, {_COMPANY_COLUMNS}, '' AS job_title, '' AS location, '' AS job_url, '' AS apply_url, '' AS careers_url,
  '' AS salary_range, '' AS job_type, '' AS job_source, 'external_careers' AS stage,
  CASE k % 20 WHEN 8 THEN 'greenhouse: payload is not valid JSON' ELSE 'greenhouse: payload root is not an object' END AS error FROM c WHERE k % 10 = 8"""
_FLAT_NOTES = f"""SELECT 'company_careers' AS source, {_COMPANY_COLUMNS}, '' AS job_title, '' AS location, '' AS job_url, '' AS apply_url,
  CASE WHEN k % 10 = 9 THEN 'https://co' || k || '.example.com/careers' ELSE '' END AS careers_url, '' AS salary_range, '' AS job_type, '' AS job_source, '' AS stage,
  CASE WHEN k % 10 = 9 THEN 'No jobs parsed (unknown ATS or empty page)' ELSE 'Could not find careers page from website' END AS error FROM c WHERE k % 10 IN (7, 9)"""
_FLAT_LISTINGS = f"""SELECT 'yc_work_at_startup' AS source, {_COMPANY_COLUMNS}, title || ' "A&B"' AS job_title, nation AS location,
  CASE WHEN sz % 12 = 0 THEN 'https://www.ycombinator.com/companies/co-' || k || '/jobs/' || pk ELSE 'https://jobs.example.org/' || pk END AS job_url,
  'https://apply.example.org/' || pk || '?a=1&b=2' AS apply_url, '' AS careers_url, CASE WHEN sz % 8 = 0 THEN '$100K – $' || sz || '0K' ELSE '' END AS salary_range,
  'Full-time' AS job_type, '' AS job_source, '' AS stage, '' AS error FROM o WHERE k % 7 < 3 AND sz % 4 = 0
UNION ALL SELECT 'error', {_COMPANY_COLUMNS}, '', '', '', '', '', '', '', '', 'yc_jobs',
  CASE k % 7 WHEN 3 THEN 'listings: HTTP status 404' ELSE 'listings: page data is not valid JSON' END FROM c WHERE k % 7 IN (3, 4)"""


@query(OPENINGS + f", {_POSTINGS}, f AS ({_FLAT_CAREERS} FROM j UNION ALL {_FLAT_ERROR} UNION ALL {_FLAT_NOTES} UNION ALL {_FLAT_LISTINGS}) SELECT * FROM f")
def all_records(spark, sf):
    """The whole flow with listings and notes, fresh intermediate tables."""
    return flatten_records(collect_jobs(*archive(spark, sf), only_hiring=False, include_listings=True, verbose=True))


@query(OPENINGS + f", {_POSTINGS} SELECT f.* FROM ({_FLAT_CAREERS} FROM j UNION ALL {_FLAT_ERROR}) f JOIN c ON f.company_slug = 'co-' || c.k WHERE c.balance >= 0")
def hiring_records(spark, sf):
    """Hiring companies only."""
    return flatten_records(collect_jobs(*archive(spark, sf)))


@query(OPENINGS + f", {_POSTINGS} {_FLAT_CAREERS} FROM (SELECT * FROM j UNION ALL {_RENDERED}) UNION ALL {_FLAT_ERROR}")
def records_with_rendered_fallback(spark, sf):
    return flatten_records(collect_jobs(*archive(spark, sf), only_hiring=False, render="fallback"))


@query(OPENINGS + f", j AS (SELECT * FROM ({_POSTINGS.strip()[6:-1]}) WHERE k % 10 < 3 UNION ALL {_RENDERED}) {_FLAT_CAREERS} FROM j UNION ALL {_FLAT_ERROR}")
def rendered_records(spark, sf):
    return flatten_records(collect_jobs(*archive(spark, sf), only_hiring=False, render="browser"))


@query(OPENINGS + _FLAT_LISTINGS)
def listing_records(spark, sf):
    return flatten_records(collect_jobs(*archive(spark, sf), only_hiring=False, include_listings=True, skip_external=True))


@query(OPENINGS + f", {_POSTINGS} SELECT (SELECT count(*) FROM j) + (SELECT count(*) FROM c WHERE k % 10 = 8) AS n_rows, (SELECT count(*) FROM j) AS n_titled")
def record_counts(spark, sf):
    from vacantia.plans.collect import external_records

    return run_summary(flatten_records(external_records(collection(spark, sf))))


@query(OPENINGS + f", {_POSTINGS} SELECT 'co-' || k AS company_slug, count(*) AS n_jobs FROM j GROUP BY k")
def openings_per_company(spark, sf):
    from vacantia.plans.collect import external_records

    return jobs_per_company(flatten_records(external_records(collection(spark, sf))))


@query(f"""
WITH w(kinds, stage, url) AS (VALUES
  ([5], 'guess', '/careers'), ([5], 'guess', '/jobs'), ([5], 'guess', '/career'), ([5], 'guess', '/join'), ([5], 'guess', '/join-us'),
  ([5], 'guess', '/about/careers'), ([5], 'guess', '/about/jobs'), ([5], 'guess', '/work-with-us'))
SELECT stage, 'https://co' || s_suppkey || '.example.com' || url AS request_url, 'http' AS render FROM supplier JOIN w ON list_contains(kinds, s_suppkey % 10)
UNION ALL SELECT 'listings', 'https://www.ycombinator.com/companies/co-' || s_suppkey || '/jobs', 'http' FROM supplier WHERE s_suppkey % 7 = 6
""")
def missing_captures(spark, sf):
    return crawl_frontier(collection(spark, sf), include_listings=True)


# --- the archive laid out by address ---------------------------------------------------------------------


@query(OPENINGS + f"""
SELECT 'co-' || k AS slug, {_SITE} || CASE WHEN k % 4 = 2 THEN '/jobs' ELSE '/careers' END AS careers_url,
  CASE WHEN sz % 2 = 0 AND sz % 6 <> 0 THEN 'A ' ELSE 'Z ' END || title AS title, {_SITE} || '/jobs/' || pk AS url FROM o WHERE k % 2 = 0
UNION ALL SELECT 'co-' || k, 'https://boards.greenhouse.io/gd' || k, p || ' ' || title, CASE WHEN sz % 3 <> 0 THEN {_SITE} || '/jobs/' || pk ELSE '' END
FROM o, (VALUES ('D'), ('E')) v(p) WHERE k % 2 = 1 AND k % 20 <> 17
""")
def board_postings(spark, sf):
    """Even companies name two boards in a page's text, the later one first: of equal addresses the board first by name counts, and
    postings without address go. The board of an odd company is its careers page: all of its postings stay, as they are.

    A captured document that is no page (`/careers` of every fourth company) is not a careers page.
    """
    o, c = X.openings(spark, sf), X.companies_base(spark, sf)
    site = "https://co{k}.example.com"
    even, odd = "k % 2 = 0", "k % 2 = 1"

    def payload(rows, titles, addressed):
        entry = lambda t: X.js(id=text("{pk}"), title=t, absolute_url=F.when(F.expr(addressed), X.quoted(site + "/jobs/{pk}")))
        listed = X.per_company(rows, F.concat_ws(",", *map(entry, titles)))
        return c.select("k").join(listed, "k", "left").select("k", F.concat(F.lit('{"jobs":['), F.coalesce("body", F.lit("")), F.lit("]}")).alias("body"))

    named = X.html(text("<p>https://boards.greenhouse.io/gz{k} or https://boards.greenhouse.io/ga{k}</p>"))
    parts = [
        X.response(c, site, F.when(F.expr(even), X.html("<p>Hello</p>")).otherwise(X.html(text('<a href="https://boards.greenhouse.io/gd{k}">Jobs</a>')))),
        X.response(c.where("k % 4 = 0"), site + "/careers", named),
        X.response(c.where("k % 4 = 2"), site + "/careers", named, content_type="application/pdf"),
        X.response(c.where("k % 4 = 2"), site + "/jobs", named),
        X.response(payload(o.where("sz % 2 = 0"), ["A {title}"], "sz % 6 <> 0").where(even), X.api(X.GH_API, "ga{k}"), "{body}", content_type="application/json"),
        X.response(payload(o, ["Z {title}"], "true").where(even), X.api(X.GH_API, "gz{k}"), "{body}", content_type="application/json"),
        X.response(payload(o, ["D {title}", "E {title}"], "sz % 3 <> 0").where(odd), X.api(X.GH_API, "gd{k}"), "{body}", content_type="application/json"),
    ]
    responses = parts[0]
    for part in parts[1:]:
        responses = responses.unionByName(part)
    found = collect_jobs(X.archive_companies(spark, sf), stage(responses, "boards"), only_hiring=False)
    return found.select(F.col("company.yc_slug").alias("slug"), "careers_url", "job.title", F.coalesce("job.url", F.lit("")).alias("url"))


def laid_out(spark: SparkSession, responses: list[DataFrame]) -> CaptureArchive:
    """A new archive with the captures as batches."""
    made = CaptureArchive.create(spark, _new_folder(spark, "captures"), buckets=16)
    for n, df in enumerate(responses):
        made.append(df, f"b{n}")
    return made


@query(f"""
SELECT {_SITE.replace('k', 's_suppkey', 1)} || path AS request_url, 'http' AS render, CAST(200 AS INT) AS status, path <> '/open-positions' OR n > 0 AS found
FROM supplier JOIN (VALUES (''), ('/company/jobs'), ('/open-positions')) v(path) ON s_suppkey % 10 = 5
JOIN (SELECT k, count(p_partkey) AS n FROM (SELECT s_suppkey AS k FROM supplier) LEFT JOIN part ON p_partkey % (SELECT count(*) FROM supplier) = k GROUP BY k) ON k = s_suppkey
WHERE path <> '/open-positions' OR n > 0
""")
def indexed_captures(spark, sf):
    """The captures of some companies, found by the index and read from the files that hold them."""
    made = laid_out(spark, [archive(spark, sf)[1]])
    keys = stage(made.latest().where(r"request_url RLIKE '^https://co\\d*5\\.example'"), "keys")
    return made.read(keys).select("request_url", "render", "status", F.col("body").contains("<html>").alias("found"))


def _two_crawls(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The archive as it was before its embedded pages had postings, and what a later crawl captured: these pages, and
    the home pages of other companies again."""
    responses = archive(spark, sf)[1]
    page = F.col("request_url").rlike(r"^https://co\d*4\.example\.com/jobs$")
    again = F.col("request_url").rlike(r"^https://co\d*[03]\.example\.com$")
    before = responses.withColumn("body", F.when(page, F.lit("<html>soon</html>")).otherwise(F.col("body")))
    return before, responses.where(page | again).withColumn("fetched_at", F.expr("fetched_at + INTERVAL 1 DAY"))


@query(OPENINGS + f", {_POSTINGS} {_FLAT_CAREERS} FROM j UNION ALL {_FLAT_ERROR}")
def records_after_changes(spark, sf):
    """A second run over an archive with a later crawl: it cuts what changed and takes over the rest."""
    companies = archive(spark, sf)[0]
    before, later = _two_crawls(spark, sf)
    made, folder = laid_out(spark, [before]), _new_folder(spark, "cuts")
    collect_jobs(companies, made, only_hiring=False, cuts=CutStore(spark, folder))
    made.append(later, "later")
    return flatten_records(collect_jobs(companies, made, only_hiring=False, cuts=CutStore(spark, folder)))


@query("""
SELECT CASE WHEN s_suppkey % 10 = 4 THEN 'changed' ELSE 'same' END AS change, 'https://co' || s_suppkey || '.example.com' || CASE WHEN s_suppkey % 10 = 4 THEN '/jobs' ELSE '' END AS request_url
FROM supplier WHERE s_suppkey % 10 IN (0, 3) OR s_suppkey % 10 = 4 AND EXISTS (SELECT 1 FROM part WHERE p_partkey % (SELECT count(*) FROM supplier) = s_suppkey)
""")
def changed_captures(spark, sf):
    """What a later crawl changed, of the addresses it captured."""
    before, later = _two_crawls(spark, sf)
    made = laid_out(spark, [before, later])
    times = lambda df: captures.latest_captures(df, "content", "file")
    index = made.index()
    changes = capture_changes(times(index.where("batch = 'b0'")), made.latest())
    return changes.join(index.where("batch = 'b1'"), ["request_url", "render"], "left_semi").select("request_url", "change")


# --- files and streams ----------------------------------------------------------------------------------


def _new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _flat_sample(spark, sf) -> DataFrame:
    """Flat rows made from the given conversations: line ends, quotes, commas and outer spaces inside values."""
    c = X.table(spark, sf, "conversations")
    null = F.lit(None).cast("string")
    records = c.select(
        F.when(F.expr("turn % 3 = 0"), V.SOURCE_LISTINGS).otherwise(V.SOURCE_CAREERS).alias("source"),
        F.struct(F.format_string("co-%d", "conv_id").alias("yc_slug"), F.col("role").alias("yc_name"), null.alias("website"), null.alias("batch")).alias("company"),
        F.format_string("https://c.org/%d", "turn").alias("careers_url"),
        job(source=F.lit("html_link"), title=F.concat(F.lit(' "'), "text", F.lit('",\n ')), url=F.format_string("https://c.org/%d/%d", "conv_id", "turn")).alias("job"),
        null.alias("note"), null.alias("stage"), null.alias("error"),
    )
    return records


_SAMPLE_SQL = """SELECT CASE WHEN turn % 3 = 0 THEN 'yc_work_at_startup' ELSE 'company_careers' END AS source, role AS company_name, 'co-' || conv_id AS company_slug,
  {null} AS batch, {null} AS website, ' "' || text || '",' || chr(10) || ' ' AS job_title, '' AS location, 'https://c.org/' || conv_id || '/' || turn AS job_url, '' AS apply_url,
  CASE WHEN turn % 3 = 0 THEN '' ELSE 'https://c.org/' || turn END AS careers_url, '' AS salary_range, '' AS job_type, CASE WHEN turn % 3 = 0 THEN '' ELSE 'html_link' END AS job_source,
  '' AS stage, '' AS error FROM conversations"""


@query(_SAMPLE_SQL.format(null="''"))
def csv_written_and_read(spark, sf):
    base = _new_folder(spark, "outputs")
    write_outputs(_flat_sample(spark, sf), base)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{base}/csv")
    return back.na.fill("")


@query(_SAMPLE_SQL.format(null="CAST(NULL AS VARCHAR)"))
def json_written_and_read(spark, sf):
    from vacantia.schemas import FLAT

    base = _new_folder(spark, "outputs")
    write_outputs(_flat_sample(spark, sf), base)
    return spark.read.schema(FLAT).json(f"{base}/json")


@query("""
SELECT CASE WHEN turn % 3 = 0 THEN 'yc_work_at_startup' ELSE 'company_careers' END AS source, 'co-' || conv_id AS slug, role AS name,
  'https://c.org/' || turn AS careers_url, ' "' || text || '",' || chr(10) || ' ' AS title, 'https://c.org/' || conv_id || '/' || turn AS url,
  'source,company,careers_url,job' AS fields, 'yc_slug,yc_name' AS company_fields, 'source,title,url' AS job_fields
FROM conversations
""")
def records_written_and_read(spark, sf):
    """The lines of the nested form: their fields in order, absent ones left out, and every value."""
    base = _new_folder(spark, "outputs")
    write_outputs(_flat_sample(spark, sf), base)
    at = lambda p: F.get_json_object("value", p)
    named = lambda x: F.array_join(F.json_object_keys(x), ",")
    return spark.read.text(f"{base}/jsonl").select(
        at("$.source").alias("source"), at("$.company.yc_slug").alias("slug"), at("$.company.yc_name").alias("name"), at("$.careers_url").alias("careers_url"),
        at("$.job.title").alias("title"), at("$.job.url").alias("url"),
        named("value").alias("fields"), named(at("$.company")).alias("company_fields"), named(at("$.job")).alias("job_fields"),
    )


@query("SELECT CAST(shard AS INT) AS shard, count(*) AS n FROM (SELECT " + _SHARD.format(key="'co-' || conv_id", n=3) + " AS shard FROM conversations) GROUP BY shard")
def records_by_shard(spark, sf):
    base = _new_folder(spark, "outputs")
    write_outputs(_flat_sample(spark, sf), base, num_shards=3)
    return spark.read.json(f"{base}/jsonl").groupBy(F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("n"))


_SHARD_SQL = _SHARD.format(key="'co-' || conv_id", n=3)


@query(f"""
WITH s AS (SELECT CAST({_SHARD_SQL} AS INT) AS shard, 'co-' || conv_id AS company_slug, ' "' || text || '",' || chr(10) || ' ' AS title, conv_id, turn FROM conversations),
p AS (SELECT shard, company_slug, title || CASE WHEN shard = 1 THEN ' again' ELSE '' END AS title, conv_id, turn FROM s WHERE shard <> 1 OR turn % 2 = 0)
SELECT kind, shard, company_slug, title, 'https://c.org/' || conv_id || '/' || turn AS url FROM p, (VALUES ('jsonl'), ('json'), ('csv')) AS k(kind)
""")
def published_records(spark, sf):
    """All shards, then one of them again with half its records under new titles, and a run over all that fails at its end."""
    base, records = _new_folder(spark, "published"), _flat_sample(spark, sf)
    publish_outputs(records, base, num_shards=3)
    shard = R.shard_index(F.col("company.yc_slug"), 3)
    again = records.withColumn("shard", shard).where(shard == 1).where(F.col("careers_url").rlike("[02468]$"))
    again = again.withColumn("job", F.col("job").withField("title", F.concat("job.title", F.lit(" again"))))
    publish_outputs(again, base, shards=[1])
    try:
        publish_outputs(records, base, num_shards=3, shards=[0, 2])
    except ValueError:
        pass
    shown = {"jsonl": ("company.yc_slug", "job.title", "job.url")}
    out = None
    for kind in KINDS:
        columns = [F.col(c).alias(n) for c, n in zip(shown.get(kind, ("company_slug", "job_title", "job_url")), ("company_slug", "title", "url"), strict=True)]
        rows = read_published(spark, base, kind).select(F.lit(kind).alias("kind"), "shard", *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(OPENINGS + f", {_POSTINGS} SELECT (SELECT count(*) FROM j) + (SELECT count(*) FROM c WHERE k % 10 = 8) AS n_rows, (SELECT count(*) FROM j) AS n_titled, (SELECT count(*) FROM c WHERE k % 10 = 8) AS n_careers_faults, CAST(0 AS BIGINT) AS n_listing_faults")
def written_counts(spark, sf):
    """Counts of a run, taken while its records are written."""
    counts = write_jobs(*archive(spark, sf), _new_folder(spark, "outputs"), only_hiring=False)
    return spark.createDataFrame([tuple(counts[n] for n in COUNTS)], ", ".join(f"{n} BIGINT" for n in COUNTS))


def _page_captures(spark, sf) -> DataFrame:
    """All captures of the archive over HTTP, failures included."""
    return archive(spark, sf)[1].where("render = 'http'")


_STREAM_SQL = OPENINGS + """
, p AS (
  SELECT 'https://co' || k || '.example.com/careers/' AS page_url, 'json_ld' AS source, title, CASE WHEN pk % 3 < 2 THEN 'https://co' || k || '.example.com/jobs/' || pk END AS url FROM o WHERE k % 10 = 3
  UNION ALL SELECT 'https://co' || k || '.example.com/jobs', 'embedded_json', title, 'https://co' || k || '.example.com/roles/' || pk FROM o WHERE k % 10 = 4
  UNION ALL SELECT 'https://co' || k || '.example.com/company/jobs', 'html_link', title, 'https://co' || k || '.example.com/jobs/' || pk FROM o WHERE k % 10 = 5 AND sz % 2 = 0
  UNION ALL SELECT 'https://co' || k || '.example.com/open-positions', 'html_link', 'X ' || title, 'https://co' || k || '.example.com/jobs/' || pk FROM o WHERE k % 10 = 5
  UNION ALL SELECT 'https://co' || k || '.example.com/careers', 'html_link', 'X ' || title, 'https://co' || k || '.example.com/jobs/' || pk FROM o WHERE k % 10 = 6
  UNION ALL SELECT 'https://co' || k || '.example.com', 'html_link', 'One', 'https://co' || k || '.example.com/jobs/' || k FROM c WHERE k % 10 = 5)
"""


@query(_STREAM_SQL + "SELECT page_url, source, title, url FROM p")
def streamed_postings(spark, sf):
    source, out = _new_folder(spark, "arrivals"), _new_folder(spark, "stream")
    _page_captures(spark, sf).write.parquet(source)
    stream.append_postings(stream.read_capture_stream(spark, source), out, out + "-state").awaitTermination()
    read = spark.read.schema("page_url STRING, job STRUCT<source: STRING, title: STRING, url: STRING>").json(out)
    return read.select("page_url", "job.*")


_FIRST_SQL = _STREAM_SQL + """
SELECT *, CAST(-1 AS INT) AS day FROM (
  SELECT page_url, source, title, url FROM p WHERE url IS NOT NULL UNION ALL SELECT DISTINCT page_url, source, title, url FROM p WHERE url IS NULL)
"""


def _arriving_thrice(spark, sf, start) -> DataFrame:
    """The same captures arrive three times: a day later they add nothing, a day earlier they take the place of the first."""
    source, store = _new_folder(spark, "arrivals"), _new_folder(spark, "store")
    captured = _page_captures(spark, sf)
    for days in (0, 1, -1):
        captured.withColumn("fetched_at", F.expr(f"fetched_at + INTERVAL '{days}' DAY")).write.mode("append").parquet(source)
        start(stream.read_capture_stream(spark, source), store, store + "-state").awaitTermination()
    kept = stream.read_store(spark, store)
    day = F.datediff("fetched_at", F.lit(captured.agg(F.min("fetched_at")).first()[0])).alias("day")
    return kept.select("page_url", "job.source", "job.title", "job.url", day)


@query(_FIRST_SQL)
def streamed_first_postings(spark, sf):
    return _arriving_thrice(spark, sf, lambda *where: stream.first_postings(*where, buckets=4))


@query(_FIRST_SQL)
def streamed_keyed_postings(spark, sf):
    return _arriving_thrice(spark, sf, stream.keyed_first_postings)


@query("""
SELECT s_suppkey AS k, CAST(s_suppkey % 3 + 1 AS INT) AS version, CAST(CASE WHEN s_suppkey % 3 = 1 THEN 404 ELSE 200 END AS INT) AS status FROM supplier
""")
def latest_responses(spark, sf):
    """One to three captures per address; the newest counts."""
    c = X.companies_base(spark, sf)
    rows = c.select("k", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("v"))
    captured = X.response(rows, "https://co{k}.example.com/{k}", "v", final="https://co{k}.example.com/{k}#{v}", status=F.expr("CASE WHEN v = 2 THEN 404 ELSE 200 END"))
    captured = captured.withColumn("fetched_at", F.expr("fetched_at + make_interval(0, 0, 0, CAST(split_part(final_url, '#', 2) AS INT))"))
    return captures.latest_captures(captured).select(
        F.regexp_extract("request_url", r"co(\d+)\.", 1).cast("bigint").alias("k"), F.split_part("final_url", F.lit("#"), F.lit(2)).cast("int").alias("version"), "status"
    )


@query("SELECT CAST(conv_id AS VARCHAR) AS a, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS b FROM conversations")
def merged_shard_files(spark, sf):
    """Shard files with different headers under the columns of the first."""
    folder = _new_folder(spark, "shards")
    c = X.table(spark, sf, "conversations").withColumn("a", F.col("conv_id").cast("string"))
    files = [c.where("turn % 2 = 0").select("a", F.col("text").alias("b")), c.where("turn % 2 = 1").select(F.lit("x").alias("extra"), "a")]
    for n, df in enumerate(files):
        write_csv(df, f"{folder}/jobs-shard{n}.csv")
    return shard_csv.read_shards(spark, f"{folder}/jobs.csv")
