"""Open roles from captured career pages, as Spark jobs."""

from vacantia.operators.flatten import flatten_records
from vacantia.operators.sinks import write_outputs
from vacantia.plans.collect import Collection, collect_jobs, write_jobs
from vacantia.plans.cuts import CutStore
from vacantia.plans.frontier import crawl_frontier
from vacantia.session import Stages, local_session, tune
from vacantia.sources.archive import CaptureArchive
from vacantia.sources.published import publish_outputs, read_published
from vacantia.sources.shard_csv import merge_shards

__all__ = [
    "CaptureArchive", "Collection", "CutStore", "Stages", "collect_jobs", "crawl_frontier", "flatten_records",
    "local_session", "merge_shards", "publish_outputs", "read_published", "tune", "write_jobs", "write_outputs",
]
