"""What earlier runs made of the captures, so that a later run cuts only what changed.

    {path}/{kind}/run=<name>/...     rows made of captures: 'parts', 'links', 'postings' of pages, 'payloads' of boards
    {path}/done/kind=<kind>/run=<name>/...   identities of the captures these rows were made of, written last

Everything made of one capture follows from what it says: address, final address, status, error and content. Their hash
is the capture's identity, `ident`, and does not hold its time: a page fetched again unchanged has the same one, and what
was made of it holds for the new capture as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schemas import IDENT
from vacantia.session import path_exists

PAGES = ("parts", "links")


#: Changes whenever the rules do by which pages are cut, so that rows kept under earlier rules are not taken over.
RULES = 2


def identity(same_site_only: bool) -> Column:
    """Hash of what a capture says and the rules it is read by. Links of pages also depend on the run's rule for other sites."""
    says = [F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("request_url", "render", "final_url", "status", "error", "content")]
    return F.md5(F.concat_ws("\x01", F.lit(f"{RULES} {same_site_only}"), *says))


class CutStore:
    """Rows kept between runs. Every run appends a folder per kind; a folder counts once its identities are written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), uuid.uuid4().hex

    def known(self, kind: str) -> DataFrame | None:
        """(ident, run): the captures whose rows of this kind are kept, each from one run."""
        done = f"{self.path}/done/kind={kind}"
        if not path_exists(self.spark, f"{done}/run=*/_SUCCESS"):
            return None
        marks = self.spark.read.schema(f"{IDENT} STRING, run STRING").option("basePath", done).parquet(f"{done}/run=*")
        return marks.groupBy(IDENT).agg(F.min("run").alias("run"))

    def missing(self, kind: str, keys: DataFrame) -> DataFrame:
        """Rows of `keys` whose captures have no kept rows of this kind."""
        known = self.known(kind)
        return keys if known is None else keys.join(known.select(IDENT), IDENT, "left_anti")

    def add(self, kind: str, keys: DataFrame, rows: DataFrame) -> None:
        """Keep the rows, which carry `ident`, made of the captures `keys`."""
        name = f"run={self.run}-{uuid.uuid4().hex}"
        rows.drop("fetched_at").write.parquet(f"{self.path}/{kind}/{name}")
        keys.select(IDENT).distinct().write.parquet(f"{self.path}/done/kind={kind}/{name}")

    def rows(self, kind: str, keys: DataFrame, like: Callable[[], DataFrame]) -> DataFrame:
        """Kept rows of the captures `keys`, with the time of these; `like` gives an empty table while there are none."""
        known = self.known(kind)
        if known is None:
            return like().limit(0)
        kept = self.spark.read.option("mergeSchema", "false").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}/run=*")
        return kept.join(keys.select(IDENT, "fetched_at").join(known, IDENT), [IDENT, "run"]).drop("run")

    def cut_in(self, kind: str) -> int:
        """How many captures this run added."""
        done = f"{self.path}/done/kind={kind}"
        if not path_exists(self.spark, f"{done}/run={self.run}-*"):
            return 0
        return self.spark.read.parquet(f"{done}/run={self.run}-*").count()
