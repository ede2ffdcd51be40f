"""Hiring-board payloads (Greenhouse, Lever, Ashby)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import variants as J
from vacantia.functions import vocabulary as V
from vacantia.functions.bind import bind
from vacantia.schemas import carried, job

VENDORS = {"greenhouse": V.GREENHOUSE_API, "lever": V.LEVER_API, "ashby": V.ASHBY_API}

# What is read of each entry of a payload that is too large to be read whole.
_ENTRY = {
    "greenhouse": "STRUCT<title: VARIANT, absolute_url: VARIANT, location: VARIANT>",
    "lever": "STRUCT<text: VARIANT, hostedUrl: VARIANT, applyUrl: VARIANT, categories: VARIANT>",
    "ashby": "STRUCT<title: VARIANT, jobUrl: VARIANT, location: VARIANT, applyUrl: VARIANT, isListed: VARIANT>",
}


def is_board_api(url: Column) -> Column:
    return url.startswith(V.GREENHOUSE_API[0]) | url.startswith(V.LEVER_API[0]) | url.startswith(V.ASHBY_API[0])


def _greenhouse(p: Column) -> Column:
    loc = J.field(p, "location")
    return job(
        source=F.lit("greenhouse"),
        title=J.text(J.field(p, "title")),
        url=J.text(J.field(p, "absolute_url")),
        location=F.when(J.is_object(loc), J.text(J.field(loc, "name"))).otherwise(J.text(loc)),
    )


def _lever(p: Column) -> Column:
    loc = F.try_variant_get(p, "$.categories.location", "variant")
    return job(
        source=F.lit("lever"),
        title=J.text(J.field(p, "text")),
        url=J.text(F.coalesce(F.when(J.truthy(J.field(p, "hostedUrl")), J.field(p, "hostedUrl")), J.field(p, "applyUrl"))),
        location=F.when(J.is_list(loc), F.array_join(F.transform(J.items(loc), J.text), ", ")).otherwise(J.text(loc)),
    )


def _ashby(p: Column) -> Column:
    return job(
        source=F.lit("ashby"),
        title=J.text(J.field(p, "title")),
        url=J.text(J.field(p, "jobUrl")),
        location=J.text(J.field(p, "location")),
        apply_url=J.text(J.field(p, "applyUrl")),
    )


def _entry_fault(p: Column, title: str, lever: bool) -> Column:
    """True when a list entry is no object, or a location list holds something other than texts."""
    # Entries with a title are objects; the others are rendered to see what they are.
    broken = J.field(p, title).isNull() & ~J.is_object(p)
    if lever:
        loc = F.try_variant_get(p, "$.categories.location", "variant")
        broken |= J.is_list(loc) & F.exists(J.items(loc), lambda x: ~J.is_text(x))
    return F.coalesce(broken, F.lit(True))


def _has_fault(jobs: Column, vendor: str) -> Column:
    lever = vendor == "lever"
    return F.exists(jobs, lambda p: _entry_fault(p, "text" if lever else "title", lever))


def _by_vendor(make: dict[str, Column]) -> Column:
    out = F
    for vendor, value in make.items():
        out = out.when(F.col("_vendor") == vendor, value)
    return out


def _entries(jobs: Column, vendor: str) -> Column:
    """ARRAY<STRUCT<board_pos, job>> of the listed entries of one vendor."""
    build = {"greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby}[vendor]
    entries = F.transform(jobs, lambda p, i: F.struct(i.alias("board_pos"), build(p).alias("job"), p.alias("_raw")))
    if vendor == "ashby":
        # Only a literal false hides an entry.
        entries = F.filter(entries, lambda e: F.coalesce(J.raw(J.field(e["_raw"], "isListed")) != "false", F.lit(True)))
    return F.transform(entries, lambda e: F.struct(e["board_pos"], e["job"]))


def _parse(payloads: DataFrame) -> DataFrame:
    """Jobs and fault of each captured payload: one pass over the payloads of all vendors."""
    body, root, jobs, vendor = F.col("body"), F.col("_root"), F.col("_jobs"), F.col("_vendor")
    lever = vendor == "lever"
    readable = (F.col("status") == 200) & F.col("error").isNull()
    ours = payloads.where(is_board_api(F.col("request_url")))
    ours = ours.withColumn("_vendor", F.coalesce(*[F.when(F.col("request_url").startswith(api[0]), v) for v, api in VENDORS.items()]))
    ours = bind(ours, _root=F.when(readable, J.parse(body)))
    # What lies beyond the size limits is read by its needed fields; few payloads, if any, are.
    large = readable & root.isNull()
    fields = {v: F.when(large & (vendor == v), J.parse_fields(body, f"ARRAY<{e}>" if v == "lever" else f"STRUCT<jobs: ARRAY<{e}>>")) for v, e in _ENTRY.items()}
    ours = bind(ours, **{f"_{v}": c for v, c in fields.items()})
    listed = F.when(lever, J.items(root)).otherwise(J.items(J.field(root, "jobs")))
    by_fields = _by_vendor({v: J.repacked(F.col(f"_{v}") if v == "lever" else F.col(f"_{v}")["jobs"]) for v in VENDORS})
    ours = bind(ours, _jobs=F.when(root.isNotNull(), listed).otherwise(by_fields), _unread=F.coalesce(*[F.when(F.col(f"_{v}").isNotNull(), False) for v in VENDORS], F.lit(True)))
    unread = F.col("_unread")
    says = lambda what: F.concat(vendor, F.lit(f": {what}"))
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status") != 200, None)
        .when(root.isNull() & J.is_large(body) & (unread | F.exists(jobs, lambda p: p.isNull())), says("payload is beyond the size limits or malformed"))
        .when(root.isNull() & unread, says("payload is not valid JSON"))
        .when(~lever & ~F.coalesce(body.rlike(r"^\s*\{"), F.lit(False)), says("payload root is not an object"))
        .when(~lever & jobs.isNull() & J.truthy(J.field(root, "jobs")), says("jobs is not a list"))
        .when(
            _by_vendor({v: _has_fault(jobs, v) for v in VENDORS}),
            says("broken entry in the job list"),
        )
    )
    entries = _by_vendor({v: _entries(jobs, v) for v in VENDORS})
    return bind(ours, fault=fault).select("request_url", "fetched_at", *carried(payloads), "fault", F.when(F.col("fault").isNull(), entries).alias("jobs"))


def board_payloads(responses: DataFrame) -> DataFrame:
    """Latest payload per address: request_url, fault, jobs ARRAY<STRUCT<board_pos, job>>.

    A payload is parsed once, however many companies or pages name its board. The vendor prefixes are
    pushed to the scan. Status other than 200 means no jobs and no fault.
    """
    http = responses.where("render = 'http'").select("request_url", "fetched_at", "status", "body", "error", *carried(responses))
    return (
        _parse(http).groupBy("request_url")
        .agg(F.max_by(F.struct("fault", "jobs", *carried(responses)), F.struct(F.col("fetched_at"), F.col("fault"))).alias("p"))
        .select("request_url", "p.*")
    )


def board_postings(payloads: DataFrame) -> DataFrame:
    """One row per listed job of the payloads: request_url, board_pos, job."""
    return payloads.where("fault IS NULL").select("request_url", F.inline("jobs"))
