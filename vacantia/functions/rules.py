"""Decision rules on URLs, paths and titles, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V
from vacantia.functions.text import normalize_title
from vacantia.functions.urls import last_segment, path_segments, trim_slashes

# Case-blind, Unicode classes, and '.', '$' that know only '\n' as a line end.
_FLAGS = "(?iUd)"
# Every alternative of the call-to-action, listing-path and listing-title patterns contains one of these.
_HUB_STEMS = "open|job|role|position|opportunit|vacanc|listing|team|hiring"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(_FLAGS + pattern)


def usable_href(href: Column) -> Column:
    """Not blank and not a jump inside the page. Expects a stripped value."""
    return (href != "") & ~href.startswith("#")


def is_script_or_mail(href: Column) -> Column:
    return href.rlike("(?i)^(javascript|mailto|tel):")


def is_ats_url(url: Column) -> Column:
    """A hiring-board name anywhere in the URL: also true for 'clever.com' and '?ref=lever.co'."""
    return matches(url, V.ATS_HOST)


def same_org(a: Column, b: Column) -> Column:
    """Of two hosts: equal, or equal first labels and none empty ('acme.com' and 'acme.careers')."""
    dot, one = F.lit("."), F.lit(1)
    return (a == b) | ((a != "") & (b != "") & (F.split_part(a, dot, one) == F.split_part(b, dot, one)))


def has_non_job_segment(low: Column) -> Column:
    """Expects a lower-case path."""
    return F.arrays_overlap(path_segments(low), F.array(*map(F.lit, V.NON_JOB_SEGMENTS)))


def path_denied(p: Column) -> Column:
    return matches(p, V.PATH_DENY)


def is_listing_path(p: Column) -> Column:
    return matches(p, V.LISTING_PAGE)


def is_listing_title(normalized: Column) -> Column:
    return matches(normalized, V.LISTING_TITLE)


def is_call_to_action(label: Column) -> Column:
    return matches(label, V.CALL_TO_ACTION)


def is_nav_title(title: Column) -> Column:
    """Empty, a section name, or a listing title."""
    t = normalize_title(title)
    return (t == "") | t.isin(V.NON_JOB_TITLES) | is_listing_title(t)


def is_job_link(low: Column, title: Column) -> Column:
    """Does a link (lower-case path and text) point to one role? An ordered decision list; first hit decides.

    Two of the rules test the last path segment.
    """
    last = last_segment(low)
    numbered = matches(low, r"/jobs?/\d+")
    slug = F.regexp_extract(low, "(?d)/(?:jobs?|careers)/([^/?#]+)/?$", 1)
    slug_job = (F.contains(slug, F.lit("-")) & (F.length(slug) >= 8)) | slug.rlike(r"(?Ud)^(?:\d{5,}-|\d{6,}$)")
    norm = normalize_title(title)
    yes, no = F.lit(True), F.lit(False)
    return (
        # No rule below accepts a path without one of these folders.
        F.when(~low.rlike("/(?:jobs?|careers|positions?|role|apply)/"), no)
        .when(path_denied(low), no)
        .when(has_non_job_segment(low), no)
        .when(last.isin(V.HUB_SEGMENTS) & ~numbered, no)
        .when(numbered, yes)
        .when(~last.isin(V.NON_JOB_SEGMENTS) & matches(low, r"/positions?/(\d+|[\w-]{8,})"), yes)
        .when(low.rlike("/role/[^/]+-[^/]+"), yes)
        .when(slug.isin(V.NON_JOB_SEGMENTS), no)
        .when(slug_job, yes)
        .when(F.contains(low, F.lit("/apply/")) & (F.length(last) >= 6), yes)
        .when(is_nav_title(title), no)
        .when(F.length(norm) < 4, no)
        .when(norm.isin(V.GENERIC_TITLES), no)
        .when(low.rlike("(?s)/(careers|jobs)/[^/]{12,}") & F.contains(last, F.lit("-")), yes)
        .otherwise(no)
    )


def careers_score(url: Column, low: Column, near: Column) -> Column:
    """How good a URL is as the careers landing page of a site; -1 when it is none.

    `low` is its lower-case path, `near` tells whether it belongs to the site's organisation.
    """
    p = trim_slashes(low)
    shallow = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) <= 2
    return (
        F.when(is_ats_url(url), 1000)
        .when(~near, -1)
        .when(has_non_job_segment(p) | path_denied(p), -1)
        .when(p.isin("/careers", "/jobs", "/job", "/career"), 900)
        .when((p.endswith("/careers") | p.endswith("/jobs")) & shallow, 850)
        .when(is_listing_path(p), 750)
        .when(p.rlike("/current-openings|/open-positions"), 700)
        .when(p.rlike("/(jobs|careers)/[^/]+"), 400)
        .when(F.lower(url).rlike("/join-us|/work-with-us|/about/careers|/about/jobs"), 350)
        .otherwise(-1)
    )


def is_careers_nav(url: Column) -> Column:
    return F.lower(url).rlike("/career|/jobs|/join-us|/work-with-us") | is_ats_url(url)


def hub_score(low: Column, label: Column) -> Column:
    """How likely a link on a careers page leads to the real list of roles; 0 when it does not. `low`: lower-case path."""
    cta = is_call_to_action(label)
    listing = is_listing_path(low)
    title = is_listing_title(normalize_title(label)) & low.rlike("/career|/job|/role")
    return (
        # A score needs a call to action or a listing path or title; all of them hold one of these word stems.
        F.when(~F.concat_ws(" ", low, F.lower(label)).rlike(_HUB_STEMS), 0)
        .when(~cta & (has_non_job_segment(low) | path_denied(low)), 0)
        .when(cta & listing, 500)
        .when(cta & low.rlike("/job|/career|/role|/position"), 450)
        .when(cta, 400)
        .when(listing, 300)
        .when(title, 250)
        .otherwise(0)
    )


# --- hiring boards ------------------------------------------------------------------------------


def board_token(url: Column, pattern: str) -> Column:
    """Board name inside a careers URL, '' if none."""
    return F.regexp_extract(url, "(?i)" + pattern, 1)


def board_api_url(vendor: str, token: Column) -> Column:
    head, tail = {"greenhouse": V.GREENHOUSE_API, "lever": V.LEVER_API, "ashby": V.ASHBY_API}[vendor]
    return F.concat(F.lit(head), token, F.lit(tail))


def direct_board(url: Column) -> Column:
    """STRUCT<vendor, token> of the board a careers URL belongs to; null when it is no known board."""
    gh, lv, ab = (board_token(url, p) for p in (V.GREENHOUSE_IN_URL, V.LEVER_IN_URL, V.ASHBY_IN_URL))
    pair = lambda name, token: F.struct(F.lit(name).alias("vendor"), token.alias("token"))
    return (
        F.when(gh != "", pair("greenhouse", gh))
        .when(lv != "", pair("lever", lv))
        .when((ab != "") & ~F.lower(ab).isin(V.ASHBY_RESERVED), pair("ashby", ab))
    )


def shard_index(key: Column, num_shards: int) -> Column:
    """Stable shard: the first 8 bytes of SHA-256 as an unsigned number, modulo the shard count."""
    if num_shards <= 1:
        return F.lit(0)
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(num_shards)).cast("int")
