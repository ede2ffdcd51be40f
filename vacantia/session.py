"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PYTHON_BATCH = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests, benchmarks and single machines. On a cluster, pass the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vacantia")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, and what bounds the memory of Python workers and what is sent by way of the driver.

    Other sizes and cluster settings are left as they are.
    """
    # The last of two equal keys of a JSON object counts, instead of the object being malformed.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The JVM never compiles methods over 8000 bytes; beyond that, generated code is slower than none.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Tables of addresses are several times as large in memory as in their files; which ones are sent to all tasks by way of the driver
    # is decided by this size.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "8")
    return small_batches(spark)


def small_batches(spark: SparkSession) -> SparkSession:
    """Whole texts and pages go to Python, where a batch takes several times its size: as Arrow, as text, as result."""
    spark.conf.set(ARROW_BYTES, str(PYTHON_BATCH))
    return spark


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vacantia-stage-"))
    return spark.sparkContext.getCheckpointDir()


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a file or folder of any of Spark's file systems matches the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def paths_of(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders of any of Spark's file systems that match the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def few(df: DataFrame, most: int = 50_000) -> bool:
    """Whether a narrow table is small enough to be sent to all tasks. It passes through the driver, once for every such join of a run."""
    return df.limit(most + 1).count() <= most


def only_among(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `df` whose key is in the written narrow table `keys`.

    While the keys are few they are sent to all tasks, so wide rows stay where they are; otherwise both sides are shuffled.
    """
    return df.join(F.broadcast(keys) if few(keys) else keys, on, "left_semi")


def dealt(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """About `rows` rows that later steps make many of, dealt over tasks by their keys, so that written they make as many even files.

    Repetitive rows take so little room in files that one reading task would get all of them: sizes of files say nothing of the work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(4 * cores, rows // 16 + 1), rows // 20_000), *keys)


class Stages:
    """Intermediate tables of one run, in a folder of its own that `close` deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.folder = f"{stage_folder(spark).rstrip('/')}/vacantia/run-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.folder}/{self.count:03d}-{name}")

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a table go as soon as the table is written, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once, to be read by several consumers.

    The written table survives lost executors, cuts lineage, keeps column pruning and filter push-down for
    its readers, and has a known size, so joins with it are planned on facts.
    """
    return _written(df, f"{stage_folder(df.sparkSession).rstrip('/')}/vacantia/{name}-{uuid.uuid4().hex}")
