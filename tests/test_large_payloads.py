"""Payloads beyond the limits of VARIANT: 16 MB a text value, 128 MB in all."""

from pyspark.sql import functions as F

from vacantia.operators.boards import board_payloads
from vacantia.operators.listings import listing_pages

GH = "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"
LV = "https://api.lever.co/v0/postings/{}?mode=json"
AB = "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=false"

def filled(responses, *rows):
    """Responses whose '@' stands for 40 MB of text."""
    return responses(*rows).withColumn("body", F.replace("body", F.lit("@"), F.repeat(F.lit("x"), 40 << 20)))


def test_one_long_text_does_not_lose_the_postings(spark, responses):
    r = filled(
        responses,
        (GH.format("a"), '{"jobs":[{"title":"T","content":"@","absolute_url":"u","location":{"name":"L"}},{"title":"S","location":"M"}]}'),
        (LV.format("a"), '[{"text":"T","description":"@","hostedUrl":"u","categories":{"location":["A","B"]}}]'),
        (AB.format("a"), '{"jobs":[{"title":"T","jobUrl":"u","d":"@"},{"title":"S","isListed":false}]}'),
    )
    out = {x.request_url: x for x in board_payloads(r).collect()}
    assert all(x.fault is None for x in out.values())
    got = {u: [(j.job.title, j.job.url, j.job.location) for j in x.jobs] for u, x in out.items()}
    assert got == {GH.format("a"): [("T", "u", "L"), ("S", None, "M")], LV.format("a"): [("T", "u", "A, B")], AB.format("a"): [("T", "u", None)]}


def test_many_small_entries_are_all_read(spark, responses):
    entry = '{"title":"T","content":"' + "x" * 1000 + '"}'
    many = F.concat(F.repeat(F.lit(entry + ","), F.col("status") * 750), F.lit(entry))
    r = responses((GH.format("a"), "")).coalesce(1).withColumn("body", F.concat(F.lit('{"jobs":['), many, F.lit("]}")))
    assert board_payloads(r).select("fault", F.size("jobs")).collect() == [(None, 150_001)]


def test_large_broken_payloads_are_faults_of_their_own(spark, responses):
    bodies = ['{"jobs":[{"title":"@"}', '{"jobs":[{"title":"T","content":"@"}]} 1', '{"jobs":[{"title":"@"}]}', '{"jobs":[{"title":"T"},7],"content":"@"}', '{"jobs":7,"content":"@"}', '["@"]']
    out = board_payloads(filled(responses, *((GH.format(i), b) for i, b in enumerate(bodies)))).collect()
    assert len(out) == len(bodies)
    assert all(x.jobs is None for x in out)
    assert {x.fault for x in out} == {"greenhouse: payload is beyond the size limits or malformed"}


def test_large_listing_pages(spark, responses):
    page = '<div data-page="{&quot;props&quot;:{&quot;jobPostings&quot;:[{&quot;title&quot;:&quot;T&quot;,&quot;d&quot;:&quot;@&quot;,&quot;url&quot;:&quot;u&quot;}]}}">'
    (out,) = listing_pages(filled(responses, ("https://www.ycombinator.com/companies/a/jobs", page))).collect()
    assert out.fault is None and [(j.title, j.url) for j in out.jobs] == [("T", "u")]
