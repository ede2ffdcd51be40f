"""Output files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vacantia.functions.text import not_blank
from vacantia.operators.flatten import flatten_records
from vacantia.session import Stages

# Quotes are doubled, blanks stay blank, values keep their outer spaces: exact on reading back.
CSV_OPTIONS = {
    "header": True, "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
_PARTITION = "shard"
#: Counts taken while records are written.
COUNTS = ("n_rows", "n_titled", "n_careers_faults", "n_listing_faults")


def observed(records: DataFrame, observation: Observation) -> DataFrame:
    """The records; once they are written, `observation` holds their COUNTS, so nothing is evaluated again for them.

    Write them without a shuffle in between: then a task that is run again counts once.
    """
    fault = lambda stage: F.count_if(F.col("error").isNotNull() & (F.col("stage") == stage))
    titled = F.count_if(not_blank(F.col("job.title")))
    counts = [F.count("*"), titled, fault("external_careers"), fault("yc_jobs")]
    return records.observe(observation, *[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)])


def _writer(df: DataFrame, mode: str, by_shard: bool):
    w = df.write.mode(mode)
    # An overwrite replaces the shards it writes and leaves the others.
    return w.partitionBy(_PARTITION).option("partitionOverwriteMode", "dynamic") if by_shard else w


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested JSON Lines. Fields that are null are left out, as absent fields are."""
    _writer(records, mode, _PARTITION in records.columns).json(path)


def write_flat_json(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat rows as JSON Lines with all 15 fields; nulls are written."""
    _writer(flat, mode, _PARTITION in flat.columns).option("ignoreNullFields", False).json(path)


def write_csv(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat rows as CSV with header; null and '' are both blank."""
    _writer(flat, mode, _PARTITION in flat.columns).options(**CSV_OPTIONS).csv(path)


def write_outputs(records: DataFrame, base: str, mode: str = "errorifexists", num_shards: int = 1, stages: Stages | None = None) -> dict[str, int]:
    """Records under {base}/jsonl and flat rows under {base}/json and {base}/csv, from one evaluation. Returns their COUNTS.

    With several shards, or records that carry their run's `shard` (`collect_jobs(with_shard=True)`), every output is
    partitioned by it. Shards written at different times with mode 'overwrite' do not touch each other.
    """
    from vacantia.functions.rules import shard_index

    if _PARTITION not in records.columns and num_shards > 1:
        records = records.withColumn(_PARTITION, shard_index(F.col("company.yc_slug"), num_shards))
    own, counts = stages or Stages(records.sparkSession), Observation("records")
    try:
        kept = own(observed(records, counts), "records")
        flat = flatten_records(kept)
        write_records(kept, f"{base}/jsonl", mode)
        write_flat_json(flat, f"{base}/json", mode)
        write_csv(flat, f"{base}/csv", mode)
        # A plan that is known to be empty is not run, and not observed.
        return {n: int(counts.get.get(n, 0)) for n in COUNTS}
    finally:
        if stages is None:
            own.close()
