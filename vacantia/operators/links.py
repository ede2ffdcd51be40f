"""Verdicts on page links: careers candidate, hub, single posting. One pass over the anchors gives all three."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import rules as R
from vacantia.functions.bind import bind
from vacantia.functions.urls import base_parts, host, path, strip_fragment, with_absolute
from vacantia.operators.html import explode_anchors
from vacantia.operators.scripts import RANK_LINK
from vacantia.schemas import carried, job


def link_targets(anchors: DataFrame, base: str = "page_url") -> DataFrame:
    """Anchors with a usable address, plus `target`: absolute against the page, without fragment."""
    usable = anchors.where(R.usable_href(F.col("href")))
    return with_absolute(usable, "target", base, "href").withColumn("target", strip_fragment(F.col("target")))


def link_facts(parts: DataFrame, same_site_only: bool = True) -> DataFrame:
    """Links that matter to a later step, narrow: one row per such anchor.

    root_tier/root_score/root_target: candidate for the careers page when the page is a site root (1 = hiring
    board named in the page, 3 = careers-like navigation). hub_score: lead to the list of roles. is_job: one role.
    """
    # Once per page: join base and host. A site root is judged by its own address: when it was redirected, its
    # links are read twice, against the page they are on and against the root.
    is_root = F.col("request_url").rlike("^https?://[^/?#]+$")
    moved = is_root & (F.col("request_url") != F.col("page_url"))
    role = lambda base, page, site: F.struct(F.col(base).alias("_url"), page.alias("_as_page"), site.alias("_as_site"))
    yes, no = F.lit(True), F.lit(False)
    roles = F.when(moved, F.array(role("page_url", yes, no), role("request_url", no, yes))).otherwise(F.array(role("page_url", yes, is_root)))
    pages = parts.select("request_url", "render", "fetched_at", "page_url", "has_ats_text", "anchors", *carried(parts), F.inline(roles))
    pages = bind(pages, _base=base_parts(F.col("_url")), _base_host=host("_url")).drop("_url")
    anchors = link_targets(explode_anchors(pages).drop("aria_label", "title_attr"), "_base").drop("_base")

    target, as_page, as_site = F.col("target"), F.col("_as_page"), F.col("_as_site")
    anchors = bind(anchors, _ats=R.is_ats_url(target), _host=host("target"), _low=F.lower(path("target")))
    tier = F.when(F.col("has_ats_text") & F.col("_ats"), 1).when(R.is_careers_nav(target), 3)
    anchors = bind(anchors, _near=F.col("_ats") | R.same_org(F.col("_base_host"), F.col("_host")), root_tier=F.when(as_site, tier)).drop("_host", "_base_host")
    # Links to other sites end here, before the costly rules.
    in_scope = F.col("_near") if same_site_only else F.lit(True)
    anchors = anchors.where((as_page & in_scope) | F.col("root_tier").isNotNull())
    low, label = F.col("_low"), F.col("label")
    anchors = bind(
        anchors,
        root_score=F.when(F.col("root_tier").isNotNull(), R.careers_score(target, low, F.col("_near"))),
        hub_score=F.when(as_page & F.col("_near") & ~R.is_script_or_mail(F.col("href")), R.hub_score(low, label)).otherwise(0),
        is_job=as_page & in_scope & (F.length("text") >= 1) & R.is_job_link(low, F.col("text")),
    )
    useful = F.coalesce(F.col("root_score") >= 0, F.lit(False))
    return anchors.where(useful | (F.col("hub_score") > 0) | F.col("is_job")).select(
        "request_url", "render", "fetched_at", "page_url", "pos", "target", "text", "hub_score", "is_job",
        F.when(useful, F.col("root_tier")).alias("root_tier"),
        F.when(useful, F.col("root_score")).alias("root_score"),
        F.when(useful, target).alias("root_target"),
        *carried(parts),
    )


def link_postings(facts: DataFrame) -> DataFrame:
    """Postings from links, in the common posting layout."""
    return facts.where("is_job").select(
        "request_url", "render", "fetched_at", "page_url",
        F.col("pos").alias("script_pos"),
        F.lit(0).alias("walk_pos"),
        job(source=F.lit("html_link"), title=F.col("text"), url=F.col("target")).alias("job"),
        F.lit(RANK_LINK).alias("extractor"),
        *carried(facts),
    )
