"""The archive laid out by address: what is opened, what counts as changed, and runs that take over earlier work."""

import os

import pytest
from pyspark.sql import functions as F

from vacantia import CaptureArchive, Collection, CutStore, Stages, collect_jobs, flatten_records, write_jobs
from vacantia.plans.cuts import identity
from vacantia.session import stage
from vacantia.sources.archive import PlainArchive, capture_changes


def site(i, extra=""):
    return [
        (f"https://s{i}.com", f'<a href="/company/jobs">Open roles</a> {"x" * 500}'),
        (f"https://s{i}.com/company/jobs", f'<a href="/jobs/{i}">Role {i}</a><a href="/jobs/9{i}">Other{extra}</a> {"y" * 500}'),
    ]


@pytest.fixture
def sites(responses):
    return responses(*[c for i in range(60) for c in site(i)])


@pytest.fixture
def laid_out(spark, sites, tmp_path):
    archive = CaptureArchive.create(spark, str(tmp_path / "archive"), buckets=16)
    archive.append(sites, "first")
    return archive


def records(df):
    return sorted(map(tuple, flatten_records(df).collect()), key=str)


def opened(df):
    return [f.removeprefix("file://") for f in df.inputFiles() if "/captures/" in f]


def test_few_companies_open_few_files(spark, laid_out):
    everything = stage(laid_out.latest(), "all")
    one = everything.where("request_url LIKE 'https://s7.com%'")
    few, all_files = opened(laid_out.read(stage(one, "one"))), opened(laid_out.read(everything))
    assert len(few) <= 2 and len(all_files) >= 12
    assert sum(map(os.path.getsize, few)) * 5 < sum(map(os.path.getsize, all_files))
    assert {r.request_url for r in laid_out.read(stage(one, "one")).collect()} == {c[0] for c in site(7)}
    # The few wanted addresses are a filter of the scan as well.
    plan = laid_out.read(stage(one, "one"))._jdf.queryExecution().executedPlan().toString()
    assert "In(request_url" in plan or "EqualTo(request_url" in plan


def test_a_run_equals_one_over_the_plain_table(spark, companies, sites, laid_out):
    c = companies(*[(f"c{i}", f"s{i}.com") for i in range(60)])
    got = records(collect_jobs(c, laid_out))
    assert got == records(collect_jobs(c, sites)) and len(got) == 120


def test_a_batch_counts_when_its_index_is_written(spark, laid_out, responses, tmp_path):
    laid_out.append(responses(*site(99)), "second")
    assert laid_out.latest().count() == 122
    os.remove(tmp_path / "archive/index/batch=second/_SUCCESS")
    os.rename(tmp_path / "archive/index/batch=second", tmp_path / "unfinished")
    assert laid_out.latest().count() == 120
    # Written again, the batch replaces what was left of it.
    laid_out.append(responses(*site(99)), "second")
    laid_out.append(responses(*site(99)), "second")
    assert laid_out.index().count() == 122


def test_a_run_reads_newest_captures_from_files_its_companies_lead_to(spark, companies, laid_out, responses):
    page = "https://s1.com/company/jobs"
    laid_out.append(responses((page, '<a href="/jobs/12">New</a>', {"at": 9})), "later")
    laid_out.append(responses((page, '<a href="/jobs/13">Old</a>', {"at": -9})), "earlier")
    seen, read = [], laid_out.read
    laid_out.read = lambda keys: seen.append(opened(read(keys))) or read(keys)
    with Collection(companies(("c", "s1.com")), laid_out) as run:
        assert [r.job.title for r in run.postings.collect()] == ["New"]
    assert seen and max(map(len, seen)) <= 2


def test_empty_archive_and_odd_rows(spark, companies, responses, tmp_path):
    archive = CaptureArchive.create(spark, str(tmp_path / "a"), buckets=4)
    assert archive.latest().count() == 0 and records(collect_jobs(companies(("a", "s1.com"), ("b", None)), archive)) == []
    archive.append(responses(), "none")
    assert archive.latest().count() == 0
    archive.append(responses(("https://x.com", None, {"error": "timed out", "status": None}), (None, "?"), ("https://y.com", "")), "odd")
    rows = {(r.request_url, r.content is None) for r in archive.latest().collect()}
    assert rows == {("https://x.com", True), (None, False), ("https://y.com", False)}
    assert archive.read(stage(archive.latest(), "odd")).count() == 2  # a capture without an address answers for none


def test_an_address_captured_very_often_is_split(spark, responses, tmp_path):
    archive = CaptureArchive.create(spark, str(tmp_path / "a"), buckets=4)
    hot = responses(("https://hot.com", "x" * 2000)).crossJoin(spark.range(3000)).drop("id")
    hot = hot.withColumn("body", F.concat("body", F.sha2(F.rand(1).cast("string"), 512))).withColumn("fetched_at", F.expr("timestamp_seconds(monotonically_increasing_id())"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        archive.append(hot.repartition(8), "hot")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert archive.index().select("file").distinct().count() > 1
    assert len(archive.files_of(archive.latest())) == 1


def test_changes(spark, laid_out, responses):
    before = stage(laid_out.latest(), "before")
    laid_out.append(responses(site(2)[0], (site(3)[1][0], "other", {"at": 5}), (site(4)[0][0], site(4)[0][1], {"at": 5}), ("https://new.com", "n"), (site(5)[0][0], None, {"at": 5, "status": 404})), "later")
    changes = {r.request_url: r.change for r in capture_changes(before, laid_out.latest()).where("change <> 'same'").collect()}
    assert changes == {site(3)[1][0]: "changed", "https://new.com": "new", site(5)[0][0]: "changed"}
    gone = capture_changes(before, before.where("request_url NOT LIKE '%s1.com%'")).where("change = 'gone'").count()
    assert gone == 2


def test_a_second_run_cuts_what_changed(spark, companies, laid_out, responses, tmp_path):
    c = companies(*[(f"c{i}", f"s{i}.com") for i in range(60)])
    first = CutStore(spark, str(tmp_path / "cuts"))
    before = records(collect_jobs(c, laid_out, cuts=first))
    assert len(before) == 120 and not any("Other new" in str(r) for r in before)
    assert first.cut_in("links") == 120 and first.cut_in("postings") == 60
    # All pages are captured again; one of them says something new.
    again = [(u, b, {"at": 7}) for i in range(60) for u, b in site(i, " new" if i == 8 else "")]
    laid_out.append(responses(*again), "again")
    second = CutStore(spark, str(tmp_path / "cuts"))
    after = records(collect_jobs(c, laid_out, cuts=second))
    assert [r for r in after if r not in before] == [r for r in after if "Other new" in str(r)] and len(after) == 120
    assert len([r for r in before if r not in after]) == 1
    assert second.cut_in("links") == 1 and second.cut_in("postings") == 1


def test_kept_rows_are_told_by_what_the_capture_says(spark, laid_out, tmp_path):
    stored = lambda: CutStore(spark, str(tmp_path / "cuts"))
    keys = lambda same_site: stage(laid_out.latest().where("request_url LIKE 'https://s1.com%'").withColumn("ident", identity(same_site)), "keys")
    own, all_sites = keys(True), keys(False)
    rows = own.select("ident", "fetched_at", "request_url")
    store = stored()
    assert store.known("links") is None and store.rows("links", own, lambda: rows).count() == 0
    store.add("links", own, rows)
    # Links kept under one rule for other sites are not taken for the other.
    assert stored().missing("links", own).count() == 0 and stored().missing("links", all_sites).count() == 2
    # Two runs that made the same rows at the same time: those of one count.
    stored().add("links", own, rows)
    later = own.withColumn("fetched_at", F.expr("fetched_at + INTERVAL 1 DAY"))
    kept = stored().rows("links", later, lambda: rows).select("request_url", "fetched_at")
    assert sorted(kept.collect()) == sorted(later.select("request_url", "fetched_at").collect())
    # Rows of a run that ended before it named them do not count.
    os.rename(tmp_path / "cuts/done/kind=links", tmp_path / "marks")
    assert stored().missing("links", own).count() == 2 and stored().cut_in("links") == 0 and store.known("links") is None


def test_a_plain_table_has_no_kept_work(spark, companies, sites, tmp_path):
    with pytest.raises(ValueError, match="CaptureArchive"):
        Collection(companies(("a", "a.com")), sites, cuts=CutStore(spark, str(tmp_path)))
    assert PlainArchive(sites).latest().count() == 120


def test_written_jobs_leave_no_intermediate_tables(spark, companies, laid_out, tmp_path):
    made = []
    plain = Stages.__init__
    try:
        Stages.__init__ = lambda self, spark: plain(self, spark) or made.append(self.folder)
        write_jobs(companies(("c", "s1.com")), laid_out, str(tmp_path / "out"), include_listings=True, max_companies=5)
        with pytest.raises(ValueError, match="render"):
            write_jobs(companies(("c", "s1.com")), laid_out, str(tmp_path / "other"), render="never")
    finally:
        Stages.__init__ = plain
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2
    assert made and not any(os.path.exists(f.removeprefix("file:")) for f in made)
