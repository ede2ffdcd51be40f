"""Newly arriving captures to postings, continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.html import page_parts
from vacantia.operators.links import link_facts
from vacantia.operators.merge import merge_postings, posting_key
from vacantia.plans.collect import page_postings
from vacantia.schemas import RESPONSES
from vacantia.session import Stages, path_exists, paths_of, tune
from vacantia.sources.captures import CAPTURE, page_captures

# Arrival order of postings: capture time first, then the order inside a page.
ARRIVAL = ["fetched_at", "extractor", "script_pos", "walk_pos"]


def read_capture_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files).parquet(folder)


def captured_postings(responses: DataFrame) -> DataFrame:
    """Postings of captured pages. Stateless: the same expression serves batch and stream.

    Parts of pages are dealt over tasks before links and scripts are made of them: sizes of files say little of that work.
    """
    parts = page_parts(page_captures(responses)).repartition(*CAPTURE)
    return page_postings(parts, link_facts(parts))


def append_postings(responses: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append postings as JSON Lines as captures arrive."""
    tune(responses.sparkSession)
    return (
        captured_postings(responses).writeStream.format("json").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def store_batch(batch: DataFrame, batch_id: int, store: str, buckets: int = 64) -> None:
    """Add the postings of one micro-batch whose (page, key) is not stored yet, or was stored from a later capture.

    Stored rows are partitioned by a hash bucket of the key, and only the buckets the batch touches are read, two narrow
    columns and the time. Each batch overwrites its own folder and looks only at earlier ones: a repeated batch gives
    the same store.
    """
    spark = batch.sparkSession
    merged = merge_postings(batch, ["page_url"], carry=["fetched_at"], order=ARRIVAL)
    with Stages(spark) as stages:
        new = stages(merged.withColumn("bucket", F.pmod(F.xxhash64("page_url", "key"), F.lit(buckets)).cast("int")), "batch")
        known = stored_rows(spark, store)
        if known is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
            known = known.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(touched))
            known = known.groupBy("bucket", "page_url", "key").agg(F.min("fetched_at").alias("known_at"))
            new = new.join(known, ["bucket", "page_url", "key"], "left").where("known_at IS NULL OR fetched_at < known_at").drop("known_at")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch_id={batch_id}")


def stored_rows(spark: SparkSession, store: str) -> DataFrame | None:
    """All stored rows, None while there are none. A key stored again from an earlier capture has several."""
    if path_exists(spark, f"{store}/batch_id=*/bucket=*"):
        return spark.read.option("basePath", store).parquet(f"{store}/batch_id=*")
    # A store of `keyed_first_postings`: its finished batches, or, written by an earlier form of it, what its file sink has committed.
    earlier = path_exists(spark, f"{store}/_spark_metadata/*")
    folders = [store] if earlier else [done.rsplit("/", 1)[0] for done in paths_of(spark, f"{store}/batch_id=*/_SUCCESS")]
    if not folders:
        return None
    rows = spark.read.option("basePath", store).parquet(*folders)
    return None if rows.isEmpty() else rows


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """Stored postings, each from its earliest capture; None while there are none."""
    rows = stored_rows(spark, store)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in ("page_url", "key")]
    arrival = [c for c in ("fetched_at", "batch_id") if c in rest]
    first = rows.groupBy("page_url", "key").agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("first"))
    return first.select("page_url", "key", "first.*")


def first_postings(responses: DataFrame, store: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keep the first posting per page and key across all batches."""
    tune(responses.sparkSession)
    return (
        captured_postings(responses).writeStream
        .foreachBatch(lambda df, n: store_batch(df, n, store, buckets))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def keep_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Write what one micro-batch gives. A repeated batch overwrites its own folder, with the same rows."""
    batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_first_postings(responses: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the first posting per page and key across all batches, known from keyed state instead of the store.

    State is the first posting per (page, key), with the batch it came in, in RocksDB and in files below `checkpoint`, hashed by the key: a
    batch looks up its own keys only, and no batch reads the store, so its work does not grow with what is stored. Rows are reduced before
    they are dealt by key, so a key with very many needs no more memory. A batch stores the keys whose first posting came in it: those
    new, and again those of an earlier capture that arrives late. Captures without a time come first.
    The number of shuffle partitions at the first start is that of the state for good. Read it with `read_store`.
    """
    spark = tune(responses.sparkSession)
    rows = captured_postings(responses).withColumn("key", posting_key(F.col("job")))
    # The time of a batch is one and the same in all its rows, and when the batch is repeated.
    order = F.struct("fetched_at", "arrived", *ARRIVAL[1:])
    first = F.min_by(F.struct("fetched_at", "job", "arrived"), order).alias("m")
    first = rows.withColumn("arrived", F.current_timestamp()).groupBy("page_url", "key").agg(first)
    first = first.where(F.col("m.arrived") == F.current_timestamp()).select("page_url", "key", "m.fetched_at", "m.job")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _ROCKSDB)  # the query takes a copy of the settings when it starts
    try:
        return (
            first.writeStream.foreachBatch(lambda df, n: keep_batch(df, n, store)).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.set(setting, before)
