"""The whole flow: companies and captured responses in, records of open roles out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import rules as R
from vacantia.functions import vocabulary as V
from vacantia.functions.urls import normalize_website
from vacantia.operators.boards import VENDORS, board_payloads
from vacantia.operators.discover import discover_careers, guessed_pages, visited_pages
from vacantia.operators.html import explode_scripts, page_address, page_parts
from vacantia.operators.links import link_facts, link_postings
from vacantia.operators.listings import listing_pages, listings_url
from vacantia.operators.merge import merge_postings
from vacantia.operators.sinks import write_outputs
from vacantia.operators.scripts import RANK_BOARD, embedded_postings, linked_data_postings
from vacantia.plans.cuts import CutStore, identity
from vacantia.schemas import COMPANY, IDENT, JOB, RECORDS, carried
from vacantia.session import Stages, dealt, tune
from vacantia.sources.archive import CaptureArchive, as_archive
from vacantia.sources.captures import CAPTURE, page_captures
from vacantia.sources.directory import select_companies

POSTING = ["request_url", "render", "fetched_at", "page_url", "extractor", "script_pos", "walk_pos", "job"]
RENDER_MODES = ("http", "browser", "fallback")


def page_postings(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """Postings found on each page by embedded JSON, JSON-LD and links. Map-only and independent of companies."""
    scripts = explode_scripts(parts.select("request_url", "render", "fetched_at", "page_url", "scripts", *carried(parts)))
    columns = [*POSTING, *carried(parts)]
    return (
        embedded_postings(scripts).select(*columns)
        .unionByName(linked_data_postings(scripts).select(*columns))
        .unionByName(link_postings(facts).select(*columns))
    )


def direct_boards(careers: DataFrame) -> DataFrame:
    """Board of each careers URL that is one: careers_url, vendor, token, request_url (of the API)."""
    board = R.direct_board(F.col("careers_url"))
    api = F.coalesce(*[F.when(F.col("b.vendor") == v, R.board_api_url(v, F.col("b.token"))) for v in VENDORS])
    return careers.select("careers_url", board.alias("b")).where("b IS NOT NULL").select(
        "careers_url", "b.vendor", "b.token", api.alias("request_url")
    )


def named_boards(visits: DataFrame, parts: DataFrame, render: str) -> DataFrame:
    """Boards named in the visited pages of each careers URL, each once at its first page, with the address of its API."""
    tokens = parts.where((F.col("render") == render) & (F.size("boards") > 0)).select("request_url", "fetched_at", F.inline("boards"))
    named = (
        visits.where("has_text").select("careers_url", "page_rank", "request_url", "fetched_at")
        .join(tokens, ["request_url", "fetched_at"])
        .groupBy("careers_url", "vendor_rank", "vendor", "token").agg(F.min("page_rank").alias("page_rank"))
    )
    return named.withColumn("request_url", F.coalesce(*[F.when(F.col("vendor") == v, R.board_api_url(v, F.col("token"))) for v in VENDORS]))


def left_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that keeps rows without a key out of the shuffle, where they would all meet in one task."""
    known = df.where(F.col(key).isNotNull()).join(other, key, "left")
    return known.unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


@dataclass
class Pass:
    """Result of reading the pages of some careers URLs in one render mode."""

    visits: DataFrame
    boards: DataFrame  # boards named in visited pages, with the state of their payload
    postings: DataFrame  # careers_url, job
    outcome: DataFrame  # careers_url, shown_url, error, has_jobs


class Collection:
    """Intermediate tables of one run. Nothing here is collected to the driver.

    Work is done per distinct careers URL, not per company: a board or page shared by a third of all
    companies is read, parsed and merged once, and fans out only in the last join.

    Only what the companies lead to is cut: their home pages and usual paths, then the careers pages found there, then
    the hub pages named on those; and only payloads of boards that these name. Each page is cut once, from its newest
    capture. Runs over shards of the companies together do the work of one run over all.

    `responses` is a table of captures, which every step scans, or a `CaptureArchive`, of which only the files that hold
    wanted captures are opened. With such an archive, `cuts` keeps what is made of captures for later runs, and takes over what
    earlier runs made of captures that are unchanged.

    Sets the session's JSON options (see `vacantia.session.tune`). `close`, or leaving a `with` block, deletes
    the intermediate tables; those in `stages` of the caller go with them.
    """

    def __init__(
        self, companies: DataFrame, responses: DataFrame | CaptureArchive, *, render: str = "http", same_site_only: bool = True,
        cuts: CutStore | None = None, stages: Stages | None = None,
    ):
        if render not in RENDER_MODES:
            raise ValueError(f"render must be one of {RENDER_MODES}")
        tune(companies.sparkSession)
        self.archive = as_archive(responses)
        if cuts is not None and not isinstance(self.archive, CaptureArchive):
            raise ValueError("only a CaptureArchive tells whether a capture changed")
        self.stage = stages or Stages(companies.sparkSession)
        self.first_render = "browser" if render == "browser" else "http"
        self.same_site_only, self.cuts = same_site_only, cuts
        self.companies = companies.withColumn("root", normalize_website(F.col("website")))
        latest = self.archive.latest().withColumn("page_url", page_address())
        self.latest = self.stage(latest.withColumn(IDENT, identity(same_site_only)) if cuts else latest, "captures")
        #: Columns that name a capture to whoever reads it.
        self.key = [*CAPTURE, *(c for c in ("file", "content", IDENT) if c in self.latest.columns)]
        self.parts = self.facts = self.payloads = None
        roots = self.companies.where("root IS NOT NULL").select("root").distinct()
        usual = guessed_pages(self.latest).where("accepted").groupBy("root").agg(F.min_by("guess_url", "guess_rank").alias("wanted_url"))
        homes = roots.select(F.col("root").alias("wanted_url"))
        self._cut(homes.unionByName(usual.join(roots, "root", "left_semi").select("wanted_url")), "http")
        self.discovered = self.stage(discover_careers(roots, self.latest, self.facts), "careers")
        careers = self.discovered.where("careers_url IS NOT NULL").select("careers_url").distinct()
        self.direct = direct_boards(careers)
        self._load(self.direct)
        direct = self.direct.join(self.payloads, "request_url", "left")
        state = direct.select("careers_url", "fault", (F.size("jobs") > 0).alias("has_jobs"))
        state = careers.join(state, "careers_url", "left")
        has_jobs = F.coalesce("has_jobs", F.lit(False))
        self.direct_outcome = state.where(F.col("fault").isNotNull() | has_jobs).select(
            "careers_url", F.col("careers_url").alias("shown_url"), F.col("fault").alias("error"), has_jobs.alias("has_jobs")
        )
        direct_postings = direct.where("fault IS NULL").select("careers_url", F.inline("jobs")).select("careers_url", "job")
        rest = state.where(F.col("fault").isNull() & ~has_jobs).select("careers_url")

        first = self._read(rest, self.first_render)
        self.passes = [first]
        outcome, postings = first.outcome, first.postings
        if render == "fallback":
            empty = first.outcome.where("error IS NULL AND NOT has_jobs").select("careers_url")
            second = self._read(empty, "browser")
            self.passes.append(second)
            outcome = first.outcome.where("error IS NOT NULL OR has_jobs").unionByName(second.outcome)
            postings = first.postings.unionByName(second.postings)
        self.outcome = self.direct_outcome.unionByName(outcome)
        self.postings = direct_postings.unionByName(postings)

    def close(self) -> None:
        self.stage.close()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _captures(self, keys: DataFrame) -> DataFrame:
        rows = self.archive.read(keys)
        return rows.withColumn(IDENT, identity(self.same_site_only)) if self.cuts else rows

    def _made(self, keys: DataFrame, kinds: dict[str, Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
        """Tables made, one from the other, of the captures in the written table `keys`; with `cuts`, of those not made before."""
        if self.cuts is None:
            tables, made = [], self._captures(keys)
            for kind, make in kinds.items():
                made = self.stage(make(made), kind)
                tables.append(made)
            return tables
        last = list(kinds)[-1]
        new = self.stage(self.cuts.missing(last, keys), "new")
        if not new.isEmpty():
            made = self._captures(new)
            for kind, make in kinds.items():
                made = self.stage(make(made), kind)
                self.cuts.add(kind, new, made)
        empty = self._captures(keys.limit(0))
        tables = []
        for kind, make in kinds.items():
            like = make(empty)
            rows = self.cuts.rows(kind, keys, lambda like=like: like).select(*like.columns)
            tables.append(self.stage(rows, kind))
            empty = like
        return tables

    def _cut(self, wanted: DataFrame, render: str) -> None:
        """Add the parts and links of the newest captures that answer for the wanted addresses."""
        usable = (F.col("render") == render) & F.col("error").isNull() & ((F.col("status") == 200) if render == "http" else F.lit(True))
        answers = self.latest.where(usable).select(*self.key, F.explode(F.array("request_url", "page_url")).alias("wanted_url"))
        keys = answers.join(wanted.select("wanted_url").distinct(), "wanted_url", "left_semi").select(*self.key).distinct()
        if self.parts is not None:
            keys = keys.join(self.parts.select(*CAPTURE), CAPTURE, "left_anti")
        keys = self.stage(keys, "wanted")
        if self.parts is not None and keys.isEmpty():
            return
        pages = keys.count()
        cut = lambda rows: dealt(page_parts(page_captures(rows)), pages, CAPTURE)
        parts, facts = self._made(keys, {"parts": cut, "links": lambda parts: link_facts(parts, self.same_site_only)})
        self.parts = parts if self.parts is None else self.parts.unionByName(parts)
        self.facts = facts if self.facts is None else self.facts.unionByName(facts)

    def _load(self, wanted: DataFrame) -> None:
        """Add the newest payloads of the wanted API addresses."""
        keys = self.latest.where("render = 'http'").select(*self.key).join(wanted.select("request_url").distinct(), "request_url", "left_semi")
        if self.payloads is not None:
            keys = keys.join(self.payloads.select("request_url"), "request_url", "left_anti")
        keys = self.stage(keys.select(*self.key), "apis")
        if self.payloads is not None and keys.isEmpty():
            return
        (payloads,) = self._made(keys, {"payloads": board_payloads})
        self.payloads = payloads if self.payloads is None else self.payloads.unionByName(payloads)

    def _postings(self, seen: DataFrame) -> DataFrame:
        """Postings found on the pages `seen` (request_url, fetched_at, render). Scripts are walked on these pages only."""
        made = lambda pages: page_postings(self.parts.join(pages, CAPTURE, "left_semi"), self.facts.join(pages, CAPTURE, "left_semi"))
        if self.cuts is None:
            return made(seen)
        keys = self.stage(self.latest.select(*CAPTURE, IDENT).join(seen, CAPTURE, "left_semi"), "seen")
        new = self.stage(self.cuts.missing("postings", keys), "unread")
        if not new.isEmpty():
            self.cuts.add("postings", new, made(new.select(*CAPTURE)))
        like = made(seen)
        return self.cuts.rows("postings", keys, lambda: like).select(*like.columns)

    def _read(self, careers: DataFrame, render: str) -> Pass:
        self._cut(careers.select(F.col("careers_url").alias("wanted_url")), render)
        visit = lambda: visited_pages(careers, self.latest, self.parts, self.facts, render)
        self._cut(visit().where("page_rank > 0").select("wanted_url"), render)
        visits = self.stage(visit(), "visits")
        named = named_boards(visits, self.parts, render)
        self._load(named)
        states = self.payloads.select("request_url", "fault", (F.size("jobs") > 0).alias("has_jobs"))
        boards = self.stage(named.join(states, "request_url", "left"), "page-boards")
        faults = boards.where("fault IS NOT NULL").groupBy("careers_url").agg(
            F.min_by("fault", F.struct("page_rank", "vendor_rank", "token")).alias("error")
        )
        listed = (
            boards.where("fault IS NULL AND has_jobs").join(self.payloads.select("request_url", "jobs"), "request_url")
            .select("careers_url", "page_rank", "vendor_rank", "token", F.inline("jobs"))
            .where(F.col("job.url") != "")
            .select(
                "careers_url", "page_rank", F.lit(RANK_BOARD).alias("extractor"), F.col("vendor_rank").alias("script_pos"),
                "token", F.col("board_pos").alias("walk_pos"), "job",
            )
        )
        # The written table of visits is narrow, so its size decides how pages are matched with it.
        found = self._postings(visits.where("has_text").select("request_url", F.lit(render).alias("render"), "fetched_at").distinct())
        on_pages = (
            visits.where("has_text").select("careers_url", "page_rank", "request_url", "fetched_at")
            .join(found.select("request_url", "fetched_at", "extractor", "script_pos", "walk_pos", "job"), ["request_url", "fetched_at"])
            .select("careers_url", "page_rank", "extractor", "script_pos", F.lit("").alias("token"), "walk_pos", "job")
        )
        merged = merge_postings(listed.unionByName(on_pages), ["careers_url"])
        # A fault anywhere loses all postings of its careers URL.
        postings = self.stage(merged.join(faults, "careers_url", "left_anti").select("careers_url", "job"), "postings")
        shown = F.when(F.col("has_text"), F.col("page_url")).otherwise(F.col("careers_url"))
        outcome = (
            visits.where("page_rank = 0").select("careers_url", shown.alias("shown_url"))
            .join(faults, "careers_url", "left")
            .join(postings.select("careers_url", F.lit(True).alias("has_jobs")).distinct(), "careers_url", "left")
            .withColumn("has_jobs", F.coalesce("has_jobs", F.lit(False)))
        )
        return Pass(visits, boards, postings, self.stage(outcome, "outcome"))

    def located_companies(self) -> DataFrame:
        """Companies with careers_url, shown_url, error, has_jobs."""
        found = self.discovered.select("root", "careers_url")
        return left_join(left_join(self.companies, found, "root"), self.outcome, "careers_url")


def _company() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(
        blank("slug").alias("yc_slug"), blank("name").alias("yc_name"), F.col("website"), F.col("batch")
    ).cast(COMPANY)


def _records(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    null = F.lit(None)
    types = {"careers_url": "string", "job": JOB, "note": "string", "stage": "string", "error": "string"}
    return df.select(
        F.lit(source).alias("source"), _company().alias("company"),
        *[columns.get(n, null).cast(t).alias(n) for n, t in types.items()],
        *[c for c in ("shard",) if c in df.columns],
    )


def external_records(run: Collection, verbose: bool = False) -> DataFrame:
    """Records of the careers stage: postings, one error record per faulty company, and notes if asked for."""
    located = run.located_companies()
    good = located.where("error IS NULL")
    out = _records(
        good.join(run.postings, "careers_url"), V.SOURCE_CAREERS, careers_url=F.col("shown_url"), job=F.col("job")
    ).unionByName(
        _records(located.where("error IS NOT NULL"), V.SOURCE_ERROR, stage=F.lit(V.STAGE_CAREERS), error=F.col("error"))
    )
    if verbose:
        nothing = good.where("careers_url IS NOT NULL AND NOT has_jobs")
        nowhere = located.where("careers_url IS NULL")
        out = out.unionByName(
            _records(nothing, V.SOURCE_CAREERS, careers_url=F.col("shown_url"), note=F.lit(V.NOTE_NO_JOBS))
        ).unionByName(_records(nowhere, V.SOURCE_CAREERS, note=F.lit(V.NOTE_NO_PAGE)))
    return out


def listing_records(companies: DataFrame, responses: DataFrame | CaptureArchive, stages: Stages | None = None) -> DataFrame:
    """Records of the directory's own listings. They are never merged with careers postings."""
    pages = listing_pages(as_archive(responses).starting(V.LISTINGS_PAGE[0], stages or Stages(companies.sparkSession)))
    joined = companies.withColumn("request_url", listings_url(F.col("slug"))).join(pages, "request_url")
    rows = joined.where("fault IS NULL").withColumn("job", F.explode("jobs"))
    faults = joined.where("fault IS NOT NULL")
    return _records(rows, V.SOURCE_LISTINGS, job=F.col("job")).unionByName(
        _records(faults, V.SOURCE_ERROR, stage=F.lit(V.STAGE_LISTINGS), error=F.col("fault"))
    )


def collect_jobs(
    companies: DataFrame,
    responses: DataFrame | CaptureArchive,
    *,
    only_hiring: bool = True,
    max_companies: int = 0,
    limit_per_shard: bool = False,
    num_shards: int = 1,
    shard: int | None = None,
    include_listings: bool = False,
    skip_external: bool = False,
    verbose: bool = False,
    with_shard: bool = False,
    render: str = "http",
    same_site_only: bool = True,
    cuts: CutStore | None = None,
    stages: Stages | None = None,
) -> DataFrame:
    """Records of all open roles of the chosen companies.

    with_shard: keep the shard of the company, by its slug or else its object id, as a column.
    render: 'http', 'browser', or 'fallback' (rendered captures for companies without postings over HTTP).
    responses, cuts: see `Collection`.
    stages: where intermediate tables are written; the records read them, so close it after the records are. Without
    it they are written to the checkpoint folder and stay there. `write_jobs` does both.
    """
    if skip_external and not include_listings:
        raise ValueError("skip_external leaves nothing to collect without include_listings")
    stages = stages or Stages(companies.sparkSession)
    chosen = select_companies(
        companies, only_hiring=only_hiring, max_companies=max_companies, num_shards=num_shards, shard=shard,
        limit_per_shard=limit_per_shard,
    )
    if max_companies:
        chosen = stages(chosen, "companies")
    parts = []
    if not skip_external:
        run = Collection(chosen, responses, render=render, same_site_only=same_site_only, cuts=cuts, stages=stages)
        parts.append(external_records(run, verbose))
    if include_listings:
        tune(companies.sparkSession)
        parts.append(listing_records(chosen, responses, stages))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    schema = companies.sparkSession.createDataFrame([], RECORDS + (", shard INT" if with_shard else "")).schema
    return out.to(schema)


def write_jobs(companies: DataFrame, responses: DataFrame | CaptureArchive, base: str, *, mode: str = "errorifexists", num_shards: int = 1, **options) -> dict[str, int]:
    """Collect and write all three outputs (see `write_outputs`), then delete the intermediate tables, also after a failure.

    `options` are those of `collect_jobs`. Returns counts of rows, titled rows and faults, taken while the records are written.
    """
    with Stages(companies.sparkSession) as stages:
        return write_outputs(collect_jobs(companies, responses, num_shards=num_shards, stages=stages, **options), base, mode, num_shards, stages)
