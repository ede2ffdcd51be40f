"""Which page of a company's site lists its jobs, and which further pages to follow from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import vocabulary as V
from vacantia.functions.text import empty_to_null
from vacantia.functions.urls import strip_fragment, trim_slashes

_GUESS = "^(https?://[^/?#]+)(" + "|".join(V.CAREER_PATHS) + ")$"


def guessed_pages(latest: DataFrame) -> DataFrame:
    """Captured responses of the usual careers paths: root, guess_rank, accepted, guess_url.

    The path is cut off the captured address, so nothing is multiplied: no eight candidates per site have to
    be shuffled to find the few that exist.
    """
    at = lambda i: F.regexp_extract("request_url", _GUESS, i)
    ok = (F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("text/html")) & F.col("error").isNull()
    return (
        latest.where((F.col("render") == "http") & F.col("request_url").rlike(_GUESS))
        .select(
            at(1).alias("root"),
            (F.array_position(F.array(*[F.lit(p) for p in V.CAREER_PATHS]), at(2)) - 1).cast("int").alias("guess_rank"),
            F.coalesce(ok, F.lit(False)).alias("accepted"),
            strip_fragment(F.coalesce(empty_to_null(F.col("final_url")), F.col("request_url"))).alias("guess_url"),
        )
    )


def best_root_links(facts: DataFrame) -> DataFrame:
    """Best careers candidate among the links of each captured site root, by tier, score and page order."""
    # Larger wins: low tier, high score, early position.
    order = F.struct(-F.col("root_tier"), F.col("root_score"), -F.col("pos"))
    return (
        facts.where((F.col("render") == "http") & F.col("root_tier").isNotNull())
        .groupBy("request_url", "fetched_at")
        .agg(F.max_by(F.struct("root_tier", "root_score", "root_target"), order).alias("link"))
    )


def discover_careers(roots: DataFrame, latest: DataFrame, facts: DataFrame) -> DataFrame:
    """Careers URL per site root: root, tier, careers_url (null when none).

    Order: a hiring-board link on the home page, the first usual path that exists, the best navigation
    link. A root whose home page was not captured with status 200 has none.
    """
    homes = latest.where("render = 'http'").select(
        F.col("request_url").alias("root"), "fetched_at", ((F.col("status") == 200) & F.col("error").isNull()).alias("home_ok")
    )
    links = best_root_links(facts).select(F.col("request_url").alias("root"), "fetched_at", "link")
    guesses = (
        guessed_pages(latest).where("accepted").groupBy("root").agg(F.min_by("guess_url", "guess_rank").alias("guess_url"))
    )
    tier = (
        F.when(~F.coalesce("home_ok", F.lit(False)), None)
        .when(F.col("link.root_tier") == 1, 1)
        .when(F.col("guess_url").isNotNull(), 2)
        .when(F.col("link.root_tier") == 3, 3)
    )
    return (
        roots.join(homes, "root", "left")
        .join(links, ["root", "fetched_at"], "left")
        .join(guesses, "root", "left")
        .withColumn("tier", tier)
        .select("root", "tier", F.when(F.col("tier") == 2, F.col("guess_url")).when(F.col("tier").isNotNull(), F.col("link.root_target")).alias("careers_url"))
    )


def rank_hubs(facts: DataFrame) -> DataFrame:
    """All pages to follow from a page: hub_url and hub_rank 1, 2, ... by score, ties in page order.

    Equal targets are reduced to their best score before the shuffle, so a group holds the distinct links of one page.
    """
    page = ["request_url", "render", "fetched_at"]
    scored = facts.where("hub_score > 0").groupBy(*page, F.col("target").alias("hub_url")).agg(
        F.max("hub_score").alias("hub_score"), F.min("pos").alias("first_pos")
    )
    order = Window.partitionBy(*page).orderBy(F.desc("hub_score"), "first_pos")
    return scored.withColumn("hub_rank", F.row_number().over(order))


def visited_pages(careers: DataFrame, latest: DataFrame, parts: DataFrame, facts: DataFrame, render: str) -> DataFrame:
    """Pages read for each careers URL: the landing page (page_rank 0) and one level of hub pages.

    Columns: careers_url, page_rank, wanted_url, and for captured pages request_url, fetched_at, page_url,
    has_text. Pages that are not captured keep nulls, so the same table also tells what is missing.
    """
    ok = F.col("error").isNull() & ((F.col("status") == 200) if render == "http" else F.lit(True))
    texts = parts.where(F.col("render") == render).select("request_url", "fetched_at", "page_url", "has_text")
    captured = (
        latest.where(F.col("render") == render)
        .select("request_url", "fetched_at", ok.alias("_ok"))
        .join(texts, ["request_url", "fetched_at"], "left")
        .select(
            "request_url", "fetched_at", F.when(F.col("_ok"), F.col("page_url")).alias("page_url"),
            (F.coalesce("_ok", F.lit(False)) & F.coalesce("has_text", F.lit(False))).alias("has_text"),
        )
    )
    # A redirected capture also answers for the address it ended at, unless that has a capture of its own.
    alias = F.when(F.col("page_url") != F.col("request_url"), F.col("page_url"))
    pages = (
        captured.select("*", F.posexplode(F.array("request_url", alias)).alias("_rank", "wanted_url"))
        .where("wanted_url IS NOT NULL")
        .groupBy("wanted_url")
        .agg(F.min_by(F.struct(*captured.columns), F.struct("_rank", "request_url")).alias("p"))
        .select("wanted_url", "p.*")
    )
    landing = careers.select("careers_url", F.lit(0).alias("page_rank"), F.col("careers_url").alias("wanted_url")).join(
        pages, "wanted_url", "left"
    )
    hubs = rank_hubs(facts.where(F.col("render") == render)).select("request_url", "fetched_at", "hub_url", "hub_rank")
    follow = (
        landing.where("has_text")
        .join(hubs, ["request_url", "fetched_at"])
        .where(trim_slashes(F.col("hub_url")) != trim_slashes(F.col("page_url")))
        .select("careers_url", F.col("hub_rank").alias("page_rank"), F.col("hub_url").alias("wanted_url"))
        .join(pages, "wanted_url", "left")
    )
    return landing.unionByName(follow)
