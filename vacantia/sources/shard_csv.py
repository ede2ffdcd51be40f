"""Imported shard files '{stem}-shard{i}.csv' and their merge."""

from __future__ import annotations

import csv
import io
from collections import Counter
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.vocabulary import CSV_FIELDS
from vacantia.operators.sinks import write_csv
from vacantia.session import Stages, path_exists
from vacantia.sources.csv_ranges import MOST_TASKS, RANGE_BYTES, range_facts, records, with_state

def shard_location(output_base: str) -> tuple[str, str]:
    """Folder and stem of shard files: a base may carry one of the output suffixes."""
    p = PurePosixPath(output_base)
    return str(p.parent), p.stem if p.suffix.lower() in (".jsonl", ".json", ".csv") else p.name


def shard_files(spark: SparkSession, output_base: str, num_shards: int | None = None) -> DataFrame | None:
    """Files of shards in merge order: path and name of the shard, shard_no, file, size; None if there are none.

    A shard is one file, or a folder of part files as Spark writes it. `num_shards` leaves out files of a wider, older run.
    """
    folder, stem = shard_location(output_base)
    path = F.regexp_extract("path", r"^(.*?-shard[^/]*\.csv)(?:/|$)", 1)
    name = F.regexp_extract("path", r"([^/]*-shard[^/]*\.csv)(?:/|$)", 1)
    number = F.coalesce(F.regexp_extract(name, r"(?i)-shard(\d+)", 1).try_cast("int"), F.lit(0))
    files = f"{folder}/{stem}-shard*.csv"
    if not path_exists(spark, files):
        return None
    # Only names are listed; the content column is not read.
    listed = spark.read.format("binaryFile").load(files)
    listed = listed.where("path NOT RLIKE '/[_.][^/]*$'").select(path.alias("path"), name.alias("name"), number.alias("shard_no"), F.col("path").alias("file"), F.col("length").alias("size"))
    if num_shards is not None:
        listed = listed.where(F.col("shard_no") < num_shards)
    return listed.orderBy("shard_no", "name", "file")


def _names(header: str) -> list[str]:
    """Column names of a header record: blank ones by place, names that occur again (in any case) with their place."""
    names = next(csv.reader(io.StringIO(header.removeprefix("\ufeff"), newline="")), [])
    times = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if times[n.lower()] > 1 else n for i, n in enumerate(names)]


def read_shards(
    spark: SparkSession, output_base: str, num_shards: int | None = None, stages: Stages | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame | None:
    """All shard files under the columns of the first one, as text; null and missing become ''. None if there are none.

    Files are read by byte ranges, so a large one is read by many tasks. Only the distinct headers and, of each of them, its first
    place come to the driver. Rows shorter than their header are filled up, longer ones cut off. The ranges are a table in
    `stages`, or else in the checkpoint folder, that the result reads.
    """
    listed = shard_files(spark, output_base, num_shards)
    if listed is None or listed.isEmpty():
        return None
    stages = stages or Stages(spark)
    files = listed.select("file", "size", "shard_no", "name")
    facts = stages(range_facts(files.select("file", "size"), range_bytes), "ranges")
    headers = facts.where("header IS NOT NULL").select("file", F.decode("header", "utf-8").alias("header"))
    place = F.min(F.struct("shard_no", "name", "file"))
    found = headers.join(files, "file").groupBy("header").agg(place.alias("place")).orderBy("place").collect()  # one row per distinct header
    first = files.agg(F.min(F.struct("shard_no", "name"))).first()[0]
    # A first shard without any header falls back to the standard columns.
    columns = _names(found[0].header) if found and found[0].place[:2] == first[:2] else list(CSV_FIELDS)
    ranges = stages(with_state(facts).join(headers, "file"), "states")
    sizes = {r["header"]: r["n"] for r in ranges.groupBy("header").agg(F.count("*").alias("n")).collect()}  # one row per distinct header
    merged = None
    for header in [r.header for r in found]:
        names = _names(header)
        fields = ", ".join("`" + c.replace("`", "``") + "` STRING" for c in names)
        rows = records(ranges.where(F.col("header") == header).repartition(min(sizes[header], MOST_TASKS), "file", "begin"))
        rows = rows.select(F.from_csv("record", fields, {"escape": '"', "multiLine": "true", "maxColumns": str(max(20480, len(names)))}).alias("r"))
        value = lambda c: F.coalesce(F.col("r").getField(c), F.lit("")) if c in names else F.lit("")
        rows = rows.select(*[value(c).alias(c) for c in columns])
        merged = rows if merged is None else merged.unionByName(rows)
    return merged if merged is not None else spark.createDataFrame([], ", ".join(f"`{c}` STRING" for c in columns))


def merge_shards(spark: SparkSession, output_base: str, destination: str | None = None, num_shards: int | None = None) -> str | None:
    """Write all shards as one CSV table; returns where, or None if there are no shard files."""
    with Stages(spark) as stages:
        merged = read_shards(spark, output_base, num_shards, stages)
        if merged is None:
            return None
        folder, stem = shard_location(output_base)
        destination = destination or f"{folder}/{stem}.csv"
        write_csv(merged, destination)
    return destination
