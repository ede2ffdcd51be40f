"""Addresses the flow needs but the archive lacks: the work list for whoever fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V
from vacantia.operators.discover import guessed_pages
from vacantia.operators.listings import listings_url
from vacantia.plans.collect import Collection


def crawl_frontier(run: Collection, include_listings: bool = False) -> DataFrame:
    """(stage, request_url, render) not yet captured. Running it again after each fetch converges."""
    http = run.latest.where("render = 'http'")
    roots = run.companies.where("root IS NOT NULL").select("root").distinct()
    row = lambda df, stage, url, render="http": df.select(
        F.lit(stage).alias("stage"), F.col(url).alias("request_url"), F.lit(render).alias("render")
    )
    wanted = row(roots, "home", "root")

    # Usual paths are tried in order until one exists, on sites whose home page names no board.
    accepted = guessed_pages(run.latest).where("accepted").groupBy("root").agg(F.min("guess_rank").alias("_first"))
    open_sites = (
        run.discovered.where("tier IS NULL OR tier > 1").select("root")
        .join(http.where("status = 200 AND error IS NULL").select(F.col("request_url").alias("root")), "root", "left_semi")
        .join(accepted, "root", "left")
    )
    paths = open_sites.select("root", "_first", F.posexplode(F.array(*[F.lit(p) for p in V.CAREER_PATHS])).alias("_rank", "_path")).where(
        "_first IS NULL OR _rank < _first"
    )
    wanted = wanted.unionByName(row(paths.withColumn("url", F.concat("root", "_path")), "guess", "url"))

    wanted = wanted.unionByName(row(run.direct, "board", "request_url"))
    for n, p in enumerate(run.passes):
        render = "browser" if n or run.first_render == "browser" else "http"
        missing = p.visits.where("request_url IS NULL")
        wanted = (
            wanted.unionByName(row(missing.where("page_rank = 0"), "careers", "wanted_url", render))
            .unionByName(row(missing.where("page_rank > 0"), "hub", "wanted_url", render))
            .unionByName(row(p.boards, "board", "request_url"))
        )
    if include_listings:
        wanted = wanted.unionByName(row(run.companies.withColumn("url", listings_url(F.col("slug"))), "listings", "url"))
    return wanted.distinct().join(run.latest.select("request_url", "render"), ["request_url", "render"], "left_anti").select(
        "stage", "request_url", "render"
    )
