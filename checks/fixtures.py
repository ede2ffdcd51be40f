"""Input tables for the checks, derived by Spark from the given tables, so they grow with them.

Let N be the number of suppliers. Supplier k is company k, and part p is an opening of company p mod N.
Each derivation is plain enough that the expected result can be stated on the base tables in SQL, without
building or parsing any HTML or JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schemas import RESPONSES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows that will grow long, dealt over many tasks: the files of a small table are read by one or two."""
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // 2000)
    return df.repartition(tasks, key)


def companies_base(spark: SparkSession, sf: str) -> DataFrame:
    """k, nation, region, balance."""
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("k"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def openings(spark: SparkSession, sf: str) -> DataFrame:
    """pk, k, title, sz, nation, region: one row per part."""
    n = table(spark, sf, "supplier").count()
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pk"), F.pmod("p_partkey", F.lit(n)).alias("k"), F.col("p_name").alias("title"),
        F.col("p_size").alias("sz"),
    )
    return part.join(companies_base(spark, sf).drop("balance"), "k")


# The same in DuckDB, as the head of a query.
OPENINGS = """
WITH c AS (
  SELECT s_suppkey AS k, n_name AS nation, r_name AS region, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), o AS (
  SELECT p_partkey AS pk, c.k, p_name AS title, p_size AS sz, nation, region
  FROM part JOIN c ON p_partkey % (SELECT count(*) FROM supplier) = c.k
)
"""


def text(template: str) -> Column:
    """Column from a template such as 'https://co{k}.example.com/jobs/{pk}'."""
    return F.expr("concat(" + ", ".join(_pieces(template)).replace("\\", "\\\\") + ")")


def sql_text(template: str) -> str:
    """The same template as a DuckDB expression."""
    return "concat('', " + ", ".join(_pieces(template) or ["''"]) + ")"


def _pieces(template: str) -> list[str]:
    out = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            out.append(f"CAST({piece} AS STRING)")
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return out


def per_company(rows: DataFrame, piece: Column, sep: str = ",", name: str = "body") -> DataFrame:
    """k and the company's pieces in part order, joined. A company has about 20 parts at every scale."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pk", piece.alias("x")))), lambda e: e["x"])
    return rows.groupBy("k").agg(F.array_join(listed, sep).alias(name))


def js(**fields: str | Column) -> Column:
    """JSON object text from templates and columns of JSON text; null columns are left out."""
    parts = []
    for name, value in fields.items():
        shown = F.concat(F.lit('"'), text(value), F.lit('"')) if isinstance(value, str) else value
        parts.append(F.concat(F.lit(f'"{name}":'), shown))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(template: str) -> Column:
    return F.concat(F.lit('"'), text(template), F.lit('"'))


def response(df: DataFrame, url: str | Column, body: str | Column | None, *, status: int | Column = 200, final: str | Column | None = None,
             content_type: str = "text/html; charset=utf-8", render: str = "http", error: Column | None = None) -> DataFrame:
    """Rows of the response archive."""
    col = lambda x: text(x) if isinstance(x, str) else x
    return df.select(
        col(url).alias("request_url"),
        F.lit(render).alias("render"),
        (col(final) if final is not None else col(url)).alias("final_url"),
        (status if isinstance(status, Column) else F.lit(status)).cast("int").alias("status"),
        F.lit(content_type).alias("content_type"),
        (col(body) if body is not None else F.lit(None)).cast("string").alias("body"),
        (error if error is not None else F.lit(None)).cast("string").alias("error"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    ).to(_schema(df.sparkSession))


_cached = {}


def _schema(spark: SparkSession):
    if "responses" not in _cached:
        _cached["responses"] = spark.createDataFrame([], RESPONSES).schema
    return _cached["responses"]


GH_API = "https://boards-api.greenhouse.io/v1/boards/{name}/jobs?content=true"
LEVER_API = "https://api.lever.co/v0/postings/{name}?mode=json"
ASHBY_API = "https://api.ashbyhq.com/posting-api/job-board/{name}?includeCompensation=false"


def api(template: str, name: str) -> str:
    return template.replace("{name}", name)


# --- board payloads -----------------------------------------------------------------------------


def greenhouse_jobs(rows: DataFrame) -> DataFrame:
    """k, body: location is an object for even sizes, plain text for odd ones."""
    loc = F.when(F.expr("sz % 2 = 0"), js(name="{nation}")).otherwise(quoted("{region}"))
    entry = js(id=text("{pk}"), title="{title}", absolute_url="https://co{k}.example.com/jobs/{pk}", location=loc)
    return per_company(rows, entry).withColumn("body", F.concat(F.lit('{"meta":{"total":1},"jobs":['), "body", F.lit("]}")))


def lever_jobs(rows: DataFrame) -> DataFrame:
    """k, body: location list when size % 3 = 0, no categories when size % 7 = 0, no hostedUrl when size % 5 = 0."""
    loc = F.when(F.expr("sz % 3 = 0"), F.concat(F.lit("["), quoted("{nation}"), F.lit(","), quoted("{region}"), F.lit("]"))).otherwise(quoted("{nation}"))
    entry = js(
        text="{title}",
        hostedUrl=F.when(F.expr("sz % 5 <> 0"), quoted("https://jobs.lever.co/lv{k}/{pk}")),
        applyUrl="https://jobs.lever.co/lv{k}/{pk}/apply",
        categories=F.when(F.expr("sz % 7 <> 0"), js(location=loc)),
    )
    return per_company(rows, entry).withColumn("body", F.concat(F.lit("["), "body", F.lit("]")))


def ashby_jobs(rows: DataFrame) -> DataFrame:
    """k, body: isListed false, true, null, absent by size % 4."""
    listed = F.expr("CASE sz % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'null' END")
    entry = js(
        title="{title}", jobUrl="https://jobs.ashbyhq.com/ab{k}/{pk}", location="{nation}",
        applyUrl="https://jobs.ashbyhq.com/ab{k}/{pk}/application", isListed=listed,
    )
    return per_company(rows, entry).withColumn("body", F.concat(F.lit('{"jobs":['), "body", F.lit('],"apiVersion":"1"}')))


# --- pages --------------------------------------------------------------------------------------


def link_list(rows: DataFrame, href: str, label: str) -> DataFrame:
    """k, body: one list item with a link per opening."""
    item = text(f'<li class="r"><a class="x" href="{href}" data-id="{{pk}}"><b>{label}</b></a></li>')
    return per_company(rows, item, "")


def html(*pieces: str | Column) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in pieces]
    head = '<!DOCTYPE html><html><head><title>Jobs</title><script>track("<a href=\'/jobs/1\'>no</a>");</script></head><body>'
    return F.concat(F.lit(head), *cols, F.lit("<!-- <a href='/jobs/2'>no</a> --></body></html>"))


# --- a whole archive ----------------------------------------------------------------------------


def archive_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Ten kinds of company by k % 10 (see `archive_responses`); 17, 37, ... have no website."""
    return companies_base(spark, sf).select(
        F.expr("CAST(k div 100 AS INT)").alias("dir_page"),
        F.expr("CAST(k % 100 AS INT)").alias("pos"),
        text("co-{k}").alias("slug"),
        text("{k}").alias("object_id"),
        text("Company {k}").alias("name"),
        F.when(F.expr("k % 20 <> 17"), text("co{k}.example.com/?utm=1")).alias("website"),
        F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE concat('W', k % 3) END").alias("batch"),
        (F.col("balance") >= 0).alias("is_hiring"),
    )


def archive_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Captured responses for every company.

    0-2 board link on the home page; 3 JSON-LD on /careers; 4 embedded JSON on /jobs; 5 navigation link,
    half the links there, all on a hub page; 6 board named in the page text plus links; 7 home page fails;
    8 broken board payload; 9 postings only in the rendered page.
    """
    o = openings(spark, sf)
    c = companies_base(spark, sf)
    kind = lambda df, *n: df.where(F.expr("k % 10").isin(*n))
    site = "https://co{k}.example.com"
    home = F.expr("k % 10")
    home_body = (
        F.when(home.isin(0, 8), html(text('<a href="/team">Team</a><a href="https://boards.greenhouse.io/gh{k}">Jobs</a>')))
        .when(home == 1, html(text('<a href="/careers">Careers</a><a href="https://jobs.lever.co/lv{k}/">Jobs</a>')))
        .when(home == 2, html(text('<a HREF=\'https://jobs.ashbyhq.com/ab{k}?x=1#t\'>Jobs</a><a href="https://lever.co/z">L</a>')))
        .when(home == 5, html(text('<a href="/careers/culture">Culture</a><a href="/jobs/{k}">One</a><a href="company/jobs">Jobs</a>')))
        .otherwise(html("<p>Hello</p>"))
    )
    out = [response(c, site, home_body, status=F.when(home == 7, 500).otherwise(200))]

    out.append(response(greenhouse_jobs(kind(o, 0)), api(GH_API, "gh{k}"), F.col("body"), content_type="application/json"))
    out.append(response(lever_jobs(kind(o, 1)), api(LEVER_API, "lv{k}"), F.col("body"), content_type="application/json"))
    out.append(response(ashby_jobs(kind(o, 2)), api(ASHBY_API, "ab{k}"), F.col("body"), content_type="application/json"))
    broken = F.when(F.expr("k % 20 = 8"), F.lit('{"jobs":[')).otherwise(F.lit("[]"))
    out.append(response(kind(c, 8), api(GH_API, "gh{k}"), broken, content_type="application/json"))

    # JSON-LD: own address, root-relative address, or none.
    url = F.expr("CASE pk % 3 WHEN 0 THEN concat('\"https://co', k, '.example.com/jobs/', pk, '\"') WHEN 1 THEN concat('\"/jobs/', pk, '\"') END")
    place = js(**{"@type": "Place", "address": js(addressLocality="{nation}", addressCountry="{region}")})
    posting = js(**{"@type": "JobPosting", "title": "{title}", "url": url, "jobLocation": place})
    ld = per_company(kind(o, 3), posting)
    out.append(
        response(ld, site + "/careers", html('<script type="application/ld+json">{"@context":"x","@graph":[', F.col("body"), "]}</script>"),
                 final=site + "/careers/#top")
    )

    # Embedded JSON.
    entry = js(id=text("{pk}"), title="{title}", jobUrl=site + "/roles/{pk}#apply", location=js(name="{nation}"))
    emb = per_company(kind(o, 4), entry)
    out.append(response(kind(c, 4), site + "/careers", "not found", status=404))
    out.append(
        response(emb, site + "/jobs", html('<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[[', F.col("body"), "]]}}</script>"))
    )

    # Links on the landing page and on a hub page.
    even, all5 = kind(o, 5).where("sz % 2 = 0"), kind(o, 5)
    landing = kind(c, 5).join(link_list(even, "/jobs/{pk}", "{title}"), "k", "left")
    out.append(
        response(landing, site + "/company/jobs",
                 html('<a href="/open-positions" aria-label="View open roles">More</a><a href="/company/jobs/">All jobs</a>', F.coalesce("body", F.lit(""))))
    )
    out.append(response(link_list(all5, "/jobs/{pk}", "X {title}"), site + "/open-positions", html(F.col("body"))))

    # A board named in the text; links repeat its openings and add the rest.
    out.append(
        response(link_list(kind(o, 6), "/jobs/{pk}", "X {title}"), site + "/careers",
                 html(text("<p>Powered by https://boards.greenhouse.io/gh{k} and HTTPS://boards.greenhouse.io/none</p>"), F.col("body")))
    )
    listed = kind(c, 6).select("k").join(greenhouse_jobs(kind(o, 6).where("sz % 2 = 0")), "k", "left")
    out.append(response(listed, api(GH_API, "gh{k}"), F.coalesce("body", F.lit('{"jobs":null}')), content_type="application/json"))
    out.append(response(kind(c, 6), api(GH_API, "none"), "gone", status=404).distinct())

    # Rendered captures.
    out.append(response(kind(c, 9), site + "/careers", html("<div id='app'></div>")))
    out.append(
        response(link_list(kind(o, 9), "/jobs/{pk}", "{title}"), site + "/careers", html(F.col("body")), render="browser",
                 final=site + "/careers?r=1")
    )

    # The directory's own listings.
    out.append(listing_responses(spark, sf))
    everything = out[0]
    for part in out[1:]:
        everything = everything.unionByName(part)
    return everything


def listing_responses(spark: SparkSession, sf: str) -> DataFrame:
    """By k % 7: 3 status 404, 4 broken page data, 5 no page data, 6 none captured; else every fourth opening."""
    entry = js(
        title='{title} \\"A&B\\"', location="{nation}", type="Full-time",
        url=F.when(F.expr("sz % 12 = 0"), quoted("/companies/co-{k}/jobs/{pk}")).otherwise(quoted("https://jobs.example.org/{pk}")),
        applyUrl="https://apply.example.org/{pk}?a=1&b=2", salaryRange=F.when(F.expr("sz % 8 = 0"), quoted("$100K – ${sz}0K")),
    )
    listed = per_company(openings(spark, sf).where("sz % 4 = 0"), entry)
    rows = companies_base(spark, sf).where("k % 7 <> 6").join(listed, "k", "left")
    payload = F.concat(F.lit('{"component":"x","props":{"jobPostings":['), F.coalesce("body", F.lit("")), F.lit("]}}"))
    escaped = F.replace(F.replace(F.replace(payload, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("–"), F.lit("&ndash;"))
    body = (
        F.when(F.expr("k % 7 = 4"), F.lit('<div id="app" data-page="{&quot;props&quot;:"></div>'))
        .when(F.expr("k % 7 = 5"), F.lit("<div>none</div>"))
        .otherwise(html(F.concat(F.lit('<div id="app" data-page="'), escaped, F.lit('"></div>'))))
    )
    return response(rows, "https://www.ycombinator.com/companies/co-{k}/jobs", body,
                    status=F.when(F.expr("k % 7 = 3"), 404).otherwise(200))
