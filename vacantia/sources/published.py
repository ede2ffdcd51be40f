"""The three outputs of a run as one: readers see all of them or none.

A run writes its files into a folder of its own under `{base}/runs`. A version then names, for every shard, the run it is
read from. Versions are small numbered files under `{base}/versions`; the next one is put there whole, by a rename that
does not replace, so two runs that end together get different numbers, and the later one builds on the earlier.
A failed run never gets a version, and its files are removed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.rules import shard_index
from vacantia.operators.sinks import CSV_OPTIONS, write_outputs
from vacantia.schemas import FLAT, RECORDS
from vacantia.session import Stages

KINDS = ("jsonl", "json", "csv")
#: Key of a run that is not cut into shards.
WHOLE = "all"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in _names(spark, f"{base}/versions") if n.endswith(".json") and n[0].isdigit())


def _put(spark: SparkSession, text: str, path: str) -> bool:
    """Write a small file that appears whole; False if there is one of the name already."""
    jvm = spark._jvm
    fs, made = _hadoop(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    names = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(names, 1)
    never[0] = names.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration()).rename(made, jvm.org.apache.hadoop.fs.Path(path), never)
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def published_version(spark: SparkSession, base: str, version: int | None = None) -> dict:
    """`version`, `runs` (shard or WHOLE, and its run) and `counts` of the run that made it, of the newest or the given version.

    Version 0 has none of them.
    """
    number = max(_numbers(spark, base), default=0) if version is None else version
    if number == 0:
        return {"version": 0, "runs": {}, "counts": {}}
    lines = spark.read.option("wholetext", True).text(f"{base}/versions/{number:010d}.json").collect()
    return json.loads(lines[0].value)


def _commit(spark: SparkSession, base: str, run: str, shards: list[str], counts: dict[str, int]) -> int:
    while True:
        last = published_version(spark, base)
        # Shards and an uncut output do not stand beside each other: the later kind replaces the other.
        runs = {} if shards == [WHOLE] else {s: r for s, r in last["runs"].items() if s != WHOLE}
        new = {"version": last["version"] + 1, "runs": runs | dict.fromkeys(shards, run), "counts": counts, "time": time.time()}
        if _put(spark, json.dumps(new), f"{base}/versions/{new['version']:010d}.json"):
            return new["version"]


def publish_outputs(records: DataFrame, base: str, *, num_shards: int = 1, shards: Iterable[int] | None = None, stages: Stages | None = None) -> int:
    """Write the three outputs of `write_outputs` and make them visible together; returns the version.

    Without shards the run replaces everything. With several (`num_shards`, or records with a `shard` column) it replaces
    the given `shards`, by default those that have records; name a shard to replace it also where it has none left.
    Records of other shards than those named are an error. On a failure nothing becomes visible and the run's files go.
    """
    spark = records.sparkSession
    base, run = base.rstrip("/"), uuid.uuid4().hex
    if "shard" not in records.columns and num_shards > 1:
        records = records.withColumn("shard", shard_index(F.col("company.yc_slug"), num_shards))
    by_shard = "shard" in records.columns
    if shards is not None and not by_shard:
        raise ValueError("shards are named, but the records have none")
    folder = f"{base}/runs/{run}"
    try:
        counts = write_outputs(records, folder, stages=stages)
        covered = [WHOLE]
        if by_shard:
            found = [n.split("=", 1)[1] for n in _names(spark, f"{folder}/csv") if n.startswith("shard=")]
            named = found if shards is None else [str(s) for s in shards]
            if strange := sorted(set(found) - set(named)):
                raise ValueError(f"records of shards that are not named: {', '.join(strange)}")
            covered = named
        return _commit(spark, base, run, covered, counts)
    except BaseException:
        fs, at = _hadoop(spark, folder)
        fs.delete(at, True)
        raise


def read_published(spark: SparkSession, base: str, kind: str, version: int | None = None) -> DataFrame:
    """Rows of one output ('jsonl', 'json', 'csv') of the newest or the given version.

    Outputs by shard have the column `shard`. An output without a version is empty. Blank CSV fields are null.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    base = base.rstrip("/")
    runs = published_version(spark, base, version)["runs"]
    by_shard = bool(runs) and WHOLE not in runs
    schema = (RECORDS if kind == "jsonl" else FLAT) + (", shard INT" if by_shard else "")
    reader = spark.read.schema(schema)
    reader = reader.format("csv").options(**CSV_OPTIONS, multiLine=True) if kind == "csv" else reader.format("json")
    out = None
    for run in sorted(set(runs.values())):
        folder = f"{base}/runs/{run}/{kind}"
        held = _names(spark, folder)
        paths = [f"{folder}/shard={s}" for s in runs if runs[s] == run and f"shard={s}" in held] if by_shard else [folder]
        if paths:
            part = reader.option("basePath", folder).load(paths)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def remove_replaced(spark: SparkSession, base: str, older_than: float) -> list[str]:
    """Delete runs that the newest version does not name and that were last written to before `older_than` (seconds of the epoch).

    Runs in progress have no version yet, so `older_than` must lie before the start of the oldest of them. Earlier versions
    that name a deleted run go as well, first. Returns the deleted runs.
    """
    base = base.rstrip("/")
    named = set(published_version(spark, base)["runs"].values())
    fs, at = _hadoop(spark, f"{base}/runs")
    found = list(fs.listStatus(at)) if fs.exists(at) else []
    gone = sorted(f.getPath().getName() for f in found if f.getPath().getName() not in named and f.getModificationTime() < older_than * 1000)
    for number in _numbers(spark, base)[:-1]:
        if set(published_version(spark, base, number)["runs"].values()) & set(gone):
            fs.delete(_hadoop(spark, f"{base}/versions/{number:010d}.json")[1], False)
    for run in gone:
        fs.delete(_hadoop(spark, f"{base}/runs/{run}")[1], True)
    return gone
