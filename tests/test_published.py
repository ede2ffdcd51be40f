"""Three outputs become visible together, shard by shard."""

import json
import time

import pytest

from vacantia.operators import sinks
from vacantia.schemas import RECORDS
from vacantia.sources import published as P


def records(spark, *rows, shard=True, stage=None):
    """Records of (slug, title, shard); those without a title are faults of `stage`."""
    schema = spark.createDataFrame([], RECORDS + ", shard INT").schema
    whole = lambda field, name, value: tuple(value if n == name else None for n in schema[field].dataType.names)
    out = [
        ("company_careers", whole("company", "yc_slug", s), None, whole("job", "title", t), None, *((stage, "x") if t is None else (None, None)), n)
        for s, t, n in rows
    ]
    df = spark.createDataFrame(out, schema)
    return df if shard else df.drop("shard")


def titles(spark, base, kind, version=None):
    rows = P.read_published(spark, base, kind, version)
    return sorted(((r.job.title if kind == "jsonl" else r.job_title) for r in rows.collect()), key=str)


def everywhere(spark, base, version=None):
    found = [titles(spark, base, k, version) for k in P.KINDS]
    assert found[0] == found[1] == found[2]
    return found[0]


def runs_of(tmp_path):
    return sorted(f.name for f in (tmp_path / "out" / "runs").iterdir())


def test_shards_replace_only_themselves(spark, tmp_path):
    base = str(tmp_path / "out")
    assert everywhere(spark, base) == []
    assert P.publish_outputs(records(spark, ("a", "A1", 0), ("b", 'B "1"\n, x', 1), ("c", "C1", 2)), base) == 1
    assert P.publish_outputs(records(spark, ("b", "B2", 1)), base, shards=[1]) == 2
    assert everywhere(spark, base) == ["A1", "B2", "C1"]
    assert everywhere(spark, base, version=1) == ["A1", 'B "1"\n, x', "C1"]
    assert {(r.job_title, r.shard) for r in P.read_published(spark, base, "csv").collect()} == {("A1", 0), ("B2", 1), ("C1", 2)}
    # A shard without rows left is replaced when it is named.
    assert P.publish_outputs(records(spark), base, shards=[2]) == 3
    assert everywhere(spark, base) == ["A1", "B2"]
    # An uncut run replaces all.
    P.publish_outputs(records(spark, ("z", "Z", 0), shard=False), base)
    assert everywhere(spark, base) == ["Z"]
    P.publish_outputs(records(spark, ("z", "Z9", 4)), base)
    assert everywhere(spark, base) == ["Z9"]


def test_a_failed_third_write_leaves_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    P.publish_outputs(records(spark, ("a", "A1", 0)), base)
    before = runs_of(tmp_path)

    def broken(*_):
        raise OSError("no space")

    monkeypatch.setattr(sinks, "write_csv", broken)
    with pytest.raises(OSError, match="no space"):
        P.publish_outputs(records(spark, ("a", "A2", 0)), base)
    assert everywhere(spark, base) == ["A1"] and runs_of(tmp_path) == before
    assert [f.name for f in (tmp_path / "out" / "versions").glob("*.json")] == ["0000000001.json"]


def test_strange_shards_are_refused(spark, tmp_path):
    base = str(tmp_path / "out")
    with pytest.raises(ValueError, match="not named: 5"):
        P.publish_outputs(records(spark, ("a", "A", 1), ("b", "B", 5)), base, shards=[1])
    with pytest.raises(ValueError, match="have none"):
        P.publish_outputs(records(spark, ("a", "A", 1), shard=False), base, shards=[1])
    assert everywhere(spark, base) == [] and runs_of(tmp_path) == []


def test_runs_that_end_together_both_count(spark, tmp_path, monkeypatch):
    """Another run commits between the look at the newest version and the own commit."""
    base = str(tmp_path / "out")
    P.publish_outputs(records(spark, ("a", "A1", 0), ("b", "B1", 1)), base)
    real, other = P._put, []

    def late(session, text, path):
        if not other:
            other.append(True)
            P.publish_outputs(records(spark, ("b", "B2", 1)), base)
        return real(session, text, path)

    monkeypatch.setattr(P, "_put", late)
    assert P.publish_outputs(records(spark, ("a", "A2", 0)), base) == 3
    assert everywhere(spark, base) == ["A2", "B2"]
    version = json.loads((tmp_path / "out" / "versions" / "0000000003.json").read_text())
    assert version["version"] == 3 and sorted(version["runs"]) == ["0", "1"]


def test_replaced_runs_are_removed(spark, tmp_path):
    base = str(tmp_path / "out")
    for i in range(3):
        P.publish_outputs(records(spark, ("a", f"A{i}", 0)), base)
    assert P.remove_replaced(spark, base, older_than=0) == [] and len(runs_of(tmp_path)) == 3
    assert len(P.remove_replaced(spark, base, older_than=time.time() + 60)) == 2
    assert everywhere(spark, base) == ["A2"] and len(runs_of(tmp_path)) == 1
    assert [f.name for f in sorted((tmp_path / "out" / "versions").glob("*.json"))] == ["0000000003.json"]


def test_counts_are_taken_while_writing(spark, tmp_path):
    some = records(spark, ("a", "A", 0), ("b", " ", 1), ("c", None, 1), stage="external_careers").unionByName(records(spark, ("d", None, 0), stage="yc_jobs"))
    want = {"n_rows": 4, "n_titled": 1, "n_careers_faults": 1, "n_listing_faults": 1}
    assert sinks.write_outputs(some, str(tmp_path / "plain")) == want
    P.publish_outputs(some.repartition(3), str(tmp_path / "out"))
    assert P.published_version(spark, str(tmp_path / "out"))["counts"] == want
    nothing = dict.fromkeys(sinks.COUNTS, 0)
    assert sinks.write_outputs(records(spark), str(tmp_path / "empty")) == nothing
    assert sinks.write_outputs(some.where("false"), str(tmp_path / "none")) == nothing
