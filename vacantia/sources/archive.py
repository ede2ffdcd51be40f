"""The response archive laid out by address, with an index of what is where.

    {path}/layout                                 number of buckets
    {path}/captures/batch=<name>/bucket=<n>/...   captures with their bodies, sorted by address
    {path}/index/batch=<name>/...                 one narrow row per capture: its facts, content hash and file

A run that follows some companies reads the index, which has no bodies, finds the newest captures it needs, and opens only
the files that hold them. Within a file the sorted addresses, their Bloom filters and small row groups let the scan skip the rest.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schemas import RESPONSES
from vacantia.session import Stages, only_among, path_exists
from vacantia.sources.captures import CAPTURE, latest_captures

INDEX = "request_url STRING, render STRING, fetched_at TIMESTAMP, final_url STRING, status INT, content_type STRING, error STRING, content STRING, file STRING, batch STRING"
COLUMNS = [field.split()[0] for field in RESPONSES.split(", ")]
ROW_GROUP_BYTES = 16 << 20
#: Up to so many addresses are named in the scan's filter; more are matched by the join alone.
MAX_PUSHED = 1000


def bucket_of(address: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(buckets)).cast("int")


class PlainArchive:
    """A table of captures in any order: every read scans it, narrowed by the wanted addresses where these are few."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def latest(self) -> DataFrame:
        return latest_captures(self.responses)

    def starting(self, prefix: str, stages: Stages) -> DataFrame:
        """Captures whose address starts so: a filter of the scan."""
        return self.responses.where(F.col("request_url").startswith(prefix))

    def read(self, keys: DataFrame) -> DataFrame:
        """Captures whose address, render mode and time are in the written table `keys`."""
        return only_among(_narrowed(self.responses, keys), keys.select(*CAPTURE), CAPTURE)


class CaptureArchive:
    """Captures in the layout above. `append` adds a batch; readers see a batch once its index is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 4096) -> CaptureArchive:
        """A new, empty archive. Choose the buckets so that one holds a few files' worth of captures in the end."""
        archive = cls(spark, path)
        spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.json(f"{archive.path}/layout")
        return archive

    @cached_property
    def buckets(self) -> int:
        return self.spark.read.schema("buckets INT").json(f"{self.path}/layout").first()[0]

    def append(self, responses: DataFrame, batch: str) -> None:
        """Add captures as a batch of its own; a batch written again replaces its earlier, perhaps unfinished, form.

        Rows are dealt by bucket; a bucket larger than a task should take, such as one whose address was captured
        again and again, is split. The content hash covers the body alone; a capture without a body has none.
        """
        rows = responses.to(self.spark.createDataFrame([], RESPONSES).schema)
        rows = rows.withColumn("content", F.md5("body")).withColumn("bucket", bucket_of(F.col("request_url"), self.buckets))
        folder = f"{self.path}/captures/batch={batch}"
        (
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *CAPTURE)
            .write.mode("overwrite").partitionBy("bucket")
            .option("parquet.bloom.filter.enabled#request_url", "true").option("parquet.block.size", str(ROW_GROUP_BYTES))
            .parquet(folder)
        )
        written = self._captures([folder], folder) if path_exists(self.spark, f"{folder}/bucket=*") else self._captures([], folder)
        facts = written.select(*CAPTURE, "final_url", "status", "content_type", "error", "content", F.col("_metadata.file_path").alias("file"))
        facts.write.mode("overwrite").parquet(f"{self.path}/index/batch={batch}")

    def _captures(self, paths: list[str], base: str) -> DataFrame:
        reader = self.spark.read.schema(f"{RESPONSES}, content STRING").option("basePath", base)
        return reader.parquet(*paths) if paths else reader.parquet(base)

    def index(self) -> DataFrame:
        """One row per capture of every finished batch, without bodies."""
        if not path_exists(self.spark, f"{self.path}/index/batch=*/_SUCCESS"):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).option("basePath", f"{self.path}/index").parquet(f"{self.path}/index/batch=*")

    def latest(self) -> DataFrame:
        """Newest capture per (request_url, render), with its content hash and file."""
        return latest_captures(self.index(), "content", "file")

    def starting(self, prefix: str, stages: Stages) -> DataFrame:
        """Newest captures whose address starts so, from the files that hold them."""
        return self.read(stages(self.latest().where(F.col("request_url").startswith(prefix)).select(*CAPTURE, "file"), "starting"))

    def files_of(self, keys: DataFrame) -> list[str]:
        """Names of the files that hold captures of `keys` (with a column `file`): file names alone are on the driver."""
        return sorted(r.file for r in keys.select("file").where("file IS NOT NULL").distinct().toLocalIterator())

    def read(self, keys: DataFrame) -> DataFrame:
        """Captures, with `content`, in the written table `keys`, taken from `latest` or `index`; other files are not opened."""
        files = self.files_of(keys)
        if not files:
            return self.spark.createDataFrame([], f"{RESPONSES}, content STRING")
        captures = self._captures(files, f"{self.path}/captures").select(*COLUMNS, "content")
        return only_among(_narrowed(captures, keys), keys.select(*CAPTURE), CAPTURE)


def _narrowed(captures: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures, with a filter the scan can use while the wanted addresses are few. The join decides in any case."""
    wanted = [r.request_url for r in keys.select("request_url").distinct().limit(MAX_PUSHED + 1).collect()]
    return captures.where(F.col("request_url").isin(wanted)) if len(wanted) <= MAX_PUSHED else captures


def as_archive(responses: DataFrame | CaptureArchive | PlainArchive) -> CaptureArchive | PlainArchive:
    return PlainArchive(responses) if isinstance(responses, DataFrame) else responses


def capture_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(request_url, render, change) between two tables of newest captures that carry `content`.

    change: 'new', 'gone', 'same' when address, final address, status and content are equal, else 'changed'.
    """
    alike = ["final_url", "status", "error", "content"]
    old = before.select("request_url", "render", F.struct(*alike).alias("old"))
    both = after.select("request_url", "render", F.struct(*alike).alias("now")).join(old, ["request_url", "render"], "full")
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone")
        .when(F.col("old").eqNullSafe(F.col("now")), "same").otherwise("changed")
    )
    return both.select("request_url", "render", change.alias("change"))
