"""The flow on small archives: rules that tables derived from the given data do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia import Collection, collect_jobs, crawl_frontier, flatten_records, merge_shards, write_outputs
from vacantia.operators.merge import merge_postings
from vacantia.schemas import job
from vacantia.sources.captures import latest_captures
from vacantia.sources.directory import companies_from_pages, read_directory_pages, select_companies, with_shard
from vacantia.sources.shard_csv import shard_files, shard_location
from vacantia.streaming import postings as stream

GH = "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"


def rows(df):
    return sorted((r.company_slug, r.source, r.job_source or r.stage, r.job_title, r.job_url, r.careers_url, r.error) for r in flatten_records(df).collect())


def test_shared_board_is_read_once_and_fans_out(companies, responses):
    """One board for many companies: one payload, one merge, postings for each company."""
    n = 60
    c = companies(*[(f"s{i}", "https://one.com") for i in range(n)], ("t", "https://two.com"))
    r = responses(
        ("https://one.com", '<a href="https://boards.greenhouse.io/big">x</a>'),
        ("https://two.com", '<a href="https://boards.greenhouse.io/big">x</a>'),
        (GH.format("big"), json.dumps({"jobs": [{"title": f"T{i}", "absolute_url": "https://same.org/1"} for i in range(5)]})),
    )
    run = Collection(c, r)
    assert run.postings.count() == 5
    # Direct board postings are not merged, even with equal addresses.
    assert collect_jobs(c, r).count() == 5 * (n + 1)


def test_newest_capture_counts(companies, responses):
    c = companies(("a", "a.com"))
    old = '<a href="/jobs/1">Old role</a>'
    r = responses(
        ("https://a.com", "x"), ("https://a.com/careers", old, {"at": 1}), ("https://a.com/careers", '<a href="/jobs/2">New role</a>', {"at": 2}),
    )
    assert [x[3] for x in rows(collect_jobs(c, r))] == ["New role"]
    assert {(x.request_url, x.fetched_at.second) for x in latest_captures(r).collect()} == {("https://a.com", 0), ("https://a.com/careers", 2)}


def test_newest_capture_may_be_a_failure(companies, responses):
    c = companies(("a", "a.com"))
    r = responses(("https://a.com", "x"), ("https://a.com/careers", '<a href="/jobs/1">Role</a>', {"at": 1}), ("https://a.com/careers", "", {"at": 2, "status": 500}))
    assert [x[6] for x in rows(collect_jobs(c, r, verbose=True))] == ["Could not find careers page from website"]


def test_redirected_home_is_judged_by_its_root(companies, responses):
    c = companies(("a", "https://a.com/x"))
    r = responses(
        ("https://a.com", '<a href="jobs/list">Jobs</a>', {"final_url": "https://www.a.com/en/"}),
        ("https://a.com/jobs/list", '<a href="/jobs/7">Seven</a>'),
    )
    assert rows(collect_jobs(c, r)) == [("a", "company_careers", "html_link", "Seven", "https://a.com/jobs/7", "https://a.com/jobs/list", "")]


def test_redirect_target_answers_for_itself(companies, responses):
    """A guessed path redirected elsewhere: its body is the page at the final address."""
    c = companies(("a", "a.com"))
    r = responses(("https://a.com", "x"), ("https://a.com/jobs", '<a href="7-senior-cook">Cook</a>', {"final_url": "https://a.com/work/jobs#x"}))
    assert [(x[4], x[5]) for x in rows(collect_jobs(c, r))] == [("https://a.com/work/jobs/7-senior-cook", "https://a.com/work/jobs")]
    assert {x.request_url for x in crawl_frontier(Collection(c, r)).collect()} == {"https://a.com/careers"}


def test_board_link_needs_no_guess_and_wins(companies, responses):
    c = companies(("a", "a.com"))
    r = responses(("https://a.com", '<a href="https://x.breezy.hr/">J</a>'), ("https://a.com/careers", '<a href="/jobs/1">No</a>'), ("https://x.breezy.hr/", '<a href="/p/jobs/12">Yes</a>'))
    assert [x[3] for x in rows(collect_jobs(c, r))] == ["Yes"]


def test_empty_board_falls_through_to_the_page(companies, responses):
    c = companies(("a", "a.com"))
    page = "https://boards.greenhouse.io/acme"
    r = responses(("https://a.com", f'<a href="{page}">J</a>'), (GH.format("acme"), '{"jobs":[]}'), (page, '<a href="/acme/jobs/5">Five</a>'))
    assert [(x[2], x[3]) for x in rows(collect_jobs(c, r))] == [("html_link", "Five")]


def test_fault_on_a_hub_page_loses_everything(companies, responses):
    c = companies(("a", "a.com"), ("b", "b.com"))
    r = responses(
        ("https://a.com", "x"), ("https://a.com/careers", '<a href="/jobs/1">One</a><a href="/open-roles">Open roles</a>'),
        ("https://a.com/open-roles", "https://boards.greenhouse.io/bad"), (GH.format("bad"), "oops"),
        ("https://b.com", "x"), ("https://b.com/careers", '<a href="/jobs/1">One</a>'),
    )
    got = rows(collect_jobs(c, r, verbose=True))
    assert [(x[0], x[1], x[2]) for x in got] == [("a", "error", "external_careers"), ("b", "company_careers", "html_link")]


def test_rendered_fallback_only_for_companies_without_postings(companies, responses):
    c = companies(("a", "a.com"), ("b", "b.com"))
    b = {"render": "browser", "status": None}
    r = responses(
        ("https://a.com", "x"), ("https://a.com/careers", '<a href="/jobs/1">Http</a>'), ("https://a.com/careers", '<a href="/jobs/2">Rendered</a>', b),
        ("https://b.com", "x"), ("https://b.com/careers", " "), ("https://b.com/careers", '<a href="/jobs/3">Rendered</a>', b),
    )
    assert [x[3] for x in rows(collect_jobs(c, r, render="fallback"))] == ["Http", "Rendered"]
    assert [x[3] for x in rows(collect_jobs(c, r, render="browser"))] == ["Rendered", "Rendered"]


def test_other_sites_need_the_option(companies, responses):
    c = companies(("a", "a.com"))
    r = responses(("https://a.com", "x"), ("https://a.com/careers", '<a href="https://else.org/jobs/1">Else</a>'))
    assert collect_jobs(c, r).count() == 0 and collect_jobs(c, r, same_site_only=False).count() == 1


def test_all_hub_pages_are_followed(companies, responses):
    c = companies(("a", "a.com"))
    hubs = "".join(f'<a href="/open-roles/{i}">Open roles</a>' for i in range(9))
    r = responses(
        ("https://a.com", "x"), ("https://a.com/careers", '<a href="/careers/">See all jobs</a>' + hubs),
        *[(f"https://a.com/open-roles/{i}", f'<a href="/jobs/{i}">Role {i}</a>') for i in range(9)],
    )
    assert [x[3] for x in rows(collect_jobs(c, r))] == [f"Role {i}" for i in range(9)]


def test_shards_are_written_apart_and_again(spark, responses, tmp_path):
    """The shard of a blank slug is that of its object id, and one shard can be rewritten alone."""
    from vacantia.operators.sinks import write_outputs
    from vacantia.schemas import COMPANIES

    c = spark.createDataFrame([(0, i, f"s{i}" if i % 3 else "", str(i), f"N{i}", f"c{i}.com", None, True) for i in range(9)], COMPANIES)
    r = responses(*[x for i in range(9) for x in ((f"https://c{i}.com", "x"), (f"https://c{i}.com/careers", f'<a href="/jobs/{i}">Role {i}</a>'))])
    base = str(tmp_path / "out")
    for shard in (0, 1, 2, 1):
        write_outputs(collect_jobs(c, r, num_shards=3, shard=shard, with_shard=True), base, mode="overwrite")
    whole = rows(collect_jobs(c, r))
    for kind in ("jsonl", "json"):
        assert spark.read.json(f"{base}/{kind}").count() == len(whole) == 9
    have = {(x["company"]["yc_name"], x["shard"]) for x in spark.read.json(f"{base}/jsonl").collect()}
    assert have == {(x.name, x.shard) for x in with_shard(c, 3).collect()}


def test_options_are_checked(companies, responses):
    c, r = companies(("a", "a.com")), responses(("https://a.com", "x"))
    for bad in ({"skip_external": True}, {"render": "no"}, {"num_shards": 0}, {"num_shards": 2, "shard": 2}, {"max_companies": -1}):
        with pytest.raises(ValueError):
            collect_jobs(c, r, **bad)


def test_shards_cover_all_companies_once(spark, companies):
    c = companies(*[(f"s{i}" if i % 5 else "", None) for i in range(100)])
    parts = [select_companies(c, num_shards=4, shard=i).select("object_id") for i in range(4)]
    ids = [r[0] for p in parts for r in p.collect()]
    assert sorted(ids) == sorted(str(i) for i in range(100))


def test_one_step_merge_equals_stepwise(spark):
    """Dropping repeats inside each extractor, then inside each page, then over pages, gives the same."""
    import random

    rnd = random.Random(11)
    data = [
        (g, rnd.randint(0, 3), e, 0, "", i, f"s{e}", rnd.choice("abc"), "" if e == 2 and rnd.random() < 0.5 else f"u{rnd.randint(0, 6)}")
        for i, (g, e) in enumerate((rnd.choice("xy"), rnd.randint(0, 3)) for _ in range(400))
    ]
    cols = "g STRING, page_rank INT, extractor INT, script_pos INT, token STRING, walk_pos INT, s STRING, t STRING, u STRING"
    df = spark.createDataFrame(data, cols).withColumn("job", job(source=F.col("s"), title=F.col("t"), url=F.col("u")))
    got = {(r.g, r.key, r.job.source, r.job.title) for r in merge_postings(df, ["g"]).collect()}

    want = set()
    for g in "xy":
        merged = []
        for page in range(4):
            found = []
            for e in range(4):
                seen = set()
                for d in sorted((d for d in data if d[:3] == (g, page, e)), key=lambda d: d[5]):
                    own = (d[8], d[7]) if e in (1, 2) else d[8]
                    if own not in seen:
                        seen.add(own)
                        found.append(d)
            merged += found
        seen = set()
        for d in merged:
            key = d[8] or f"{d[6]}:{d[7]}"
            if key not in seen:
                seen.add(key)
                want.add((g, key, d[6], d[7]))
    assert got == want


def test_directory_files(spark, tmp_path):
    pages = [{"dir_page": p, "hits": [{"slug": f"s{p}", "objectID": p, "isHiring": True}], "nbPages": 2} for p in range(4)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, pages)))
    assert sorted(r.slug for r in read_directory_pages(spark, str(tmp_path)).collect()) == ["s0", "s1"]
    bodies = spark.createDataFrame([(0, '{"hits":[{"slug":"a"}]}'), (1, '{"hits":[{"slug":"b"}]}')], "dir_page INT, body STRING")
    assert [r.slug for r in companies_from_pages(bodies).collect()] == ["a"]


def test_outputs_and_shard_merge(spark, tmp_path, companies, responses):
    c = companies(("a", "a.com"))
    r = responses(("https://a.com", "x"), ("https://a.com/careers", '<a href="/jobs/1">One, "two"</a>'))
    records = collect_jobs(c, r)
    write_outputs(records, str(tmp_path / "out"))
    written = lambda kind: json.loads("".join(f.read_text() for f in (tmp_path / "out" / kind).glob("part*.json")))
    line = written("jsonl")
    assert line["job"] == {"source": "html_link", "title": 'One, "two"', "url": "https://a.com/jobs/1"}
    flat = written("json")
    assert len(flat) == 15 and flat["batch"] is None and flat["apply_url"] == ""

    (tmp_path / "jobs-shard10.csv").write_text('a,b\n1,"x\ny ""q"""\n')
    (tmp_path / "jobs-shard2.csv").write_text("b,a,c\n2,,9\n")
    base = str(tmp_path / "jobs.jsonl")
    assert [x.name for x in shard_files(spark, base).collect()] == ["jobs-shard2.csv", "jobs-shard10.csv"]
    assert [x.name for x in shard_files(spark, base, num_shards=5).collect()] == ["jobs-shard2.csv"]
    out = merge_shards(spark, base)
    got = spark.read.options(header=True, multiLine=True, escape='"').csv(out).na.fill("")
    assert got.columns == ["b", "a", "c"] and sorted(map(tuple, got.collect())) == [("2", "", "9"), ('x\ny "q"', "1", "")]
    assert merge_shards(spark, str(tmp_path / "none")) is None
    assert shard_location("d/out.v1") == ("d", "out.v1") and shard_location("d/x.CSV") == ("d", "x")


def test_repeated_batch_changes_nothing(spark, tmp_path, responses):
    store = str(tmp_path / "store")
    one = stream.captured_postings(responses(("https://a.com/careers", '<a href="/jobs/1">One</a><a href="/jobs/2">Two</a>')))
    two = stream.captured_postings(responses(("https://a.com/careers", '<a href="/jobs/2">Zwei</a><a href="/jobs/3">Drei</a>', {"at": 9})))
    for df, n in ((one, 0), (two, 1), (two, 1), (one, 0)):
        stream.store_batch(df, n, store, buckets=2)
    assert sorted(r.job.title for r in stream.read_store(spark, store).collect()) == ["Drei", "One", "Two"]


def test_plans(spark, tmp_path, companies, responses):
    """Narrow scans where bodies are not needed, address filters at the scan, no cross joins, no hot windows."""
    responses(("https://a.com", "x")).write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan(latest_captures(r))
    from vacantia.operators.boards import board_payloads

    assert plan(board_payloads(r)).count("StringStartsWith(request_url,https://") == 3
    run = Collection(companies(("a", "a.com")), r)
    for df in (run.located_companies(), run.postings, crawl_frontier(run)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_only_the_pages_of_the_companies_are_cut(companies, responses):
    import os

    page = '<a href="/jobs/1">One</a><a href="/open-roles">Open roles</a>'
    sites = [f"https://{x}.com" for x in "abc"]
    r = responses(
        *[(s, "x") for s in sites], *[(f"{s}/careers", page) for s in sites], *[(f"{s}/open-roles", page) for s in sites],
        ("https://a.com/careers", "old", {"at": -5}), ("https://a.com/other", page), (GH.format("z"), '{"jobs": []}'),
    )
    whole = None
    for names in ("a", "bc", "abc"):
        with Collection(companies(*[(x, f"{x}.com") for x in names]), r) as run:
            cut = {x.request_url for x in run.parts.collect()}
            assert cut == {f"https://{x}.com{p}" for x in names for p in ("", "/careers", "/open-roles")}
            assert run.parts.count() == 3 * len(names) and run.payloads.count() == 0
            whole = (whole or []) + [run.facts.count()]
            folder = run.stage.folder
        assert not os.path.exists(folder.removeprefix("file:"))
    assert whole[0] + whole[1] == whole[2]


def test_stage_folder_must_be_shared_on_a_cluster(monkeypatch):
    from vacantia import session

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.stage_folder(Fake)


def test_keyed_postings_over_batches(spark, tmp_path, responses):
    """Later, equal and repeated captures add nothing, an earlier one counts; each batch is stored once and no batch reads the store."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    page = "https://a.com/careers"
    batches = [
        [(page, '<a href="/jobs/1">One</a><a href="/jobs/2">Two</a>', {"at": 50}), (page, '<a href="/jobs/1">Eins</a>', {"at": 40})],
        [(page, '<a href="/jobs/2">Zwei</a><a href="/jobs/3">Drei</a>', {"at": 60})],
        [(page, '<a href="/jobs/3">Trois</a>', {"at": 10})],
        [(page, '<a href="/jobs/3">Tres</a>', {"at": 10})],
    ]
    assert stream.read_store(spark, store) is None
    sizes = []
    for rows in batches:
        responses(*rows).write.mode("append").parquet(source)
        stream.keyed_first_postings(stream.read_capture_stream(spark, source), store, str(tmp_path / "state")).awaitTermination()
        sizes.append(stream.stored_rows(spark, store).count())
    assert sizes == [2, 3, 4, 4]
    assert sorted(r.job.title for r in stream.read_store(spark, store).collect()) == ["Eins", "Trois", "Two"]
    # Started again without new captures, nothing changes.
    stream.keyed_first_postings(stream.read_capture_stream(spark, source), store, str(tmp_path / "state")).awaitTermination()
    assert stream.stored_rows(spark, store).count() == 4


def test_python_batches_and_tables_sent_to_all_tasks_are_bounded(spark, tmp_path):
    from pyspark.sql import functions as F

    from vacantia.session import few, tune

    tune(spark)
    sizes = spark.range(64, numPartitions=1).select(F.expr("repeat('x', 1000000)").alias("page"))

    @F.pandas_udf("long")
    def together(pages):
        import pandas as pd

        return pd.Series([len(pages)] * len(pages))

    assert sizes.select(together("page").alias("n")).agg(F.max("n")).first()[0] <= 16  # 64 before
    assert few(spark.range(50_000)) and not few(spark.range(50_001))
    path = str(tmp_path / "keys")
    # Some 40 MB of addresses in a file of a few: sent to all tasks before.
    spark.range(400_000).select(F.concat(F.lit("https://www.a-long-name-of-a-site.example.com/careers/"), "id").alias("request_url")).coalesce(1).write.parquet(path)
    keys = spark.read.parquet(path)
    plan = keys.join(keys.withColumnRenamed("request_url", "u"), F.col("u") == F.col("request_url"), "left_semi")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_parts_of_one_file_are_dealt_over_files(spark, companies, responses):
    """Many pages of one small file: their parts and links are made and read by several tasks, as sizes of files say nothing of the work."""
    sites = [(f"s{i}", f"https://s{i}.com") for i in range(200)]
    captured = responses(*[(site, "<a href='/jobs'>Jobs</a>") for _, site in sites]).coalesce(1)
    with Collection(companies(*sites), captured) as run:
        for table in (run.parts, run.facts):
            counts = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
            assert sum(counts) == 200 and max(counts) <= 60  # one file of 200 before


def test_keyed_postings_keep_no_state_in_python(spark, tmp_path, responses):
    """Keys are looked up where the state is, not one by one from Python; a posting given again at the same time is not stored again."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for at in (5, 5, 4):
        rows = [(f"https://a.com/{i}/careers", f'<a href="/jobs/{at}">At {at}</a><a href="/jobs/1">One</a>', {"at": at}) for i in range(3)]
        responses(*rows).write.mode("append").parquet(source)
        query = stream.keyed_first_postings(stream.read_capture_stream(spark, source), store, str(tmp_path / "state"))
        query.awaitTermination()
        assert [o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]][0] == "stateStoreSave"  # transformWithState in Python before
    assert stream.stored_rows(spark, store).count() == 12  # 6, none, 3 new and 3 of an earlier capture
    assert sorted((r.job.title, r.fetched_at.second) for r in stream.read_store(spark, store).collect()) == [("At 4", 4)] * 3 + [("At 5", 5)] * 3 + [("One", 4)] * 3
