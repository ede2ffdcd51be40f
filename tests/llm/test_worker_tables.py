"""Python workers stay for later stages; what a stage builds in them does not."""

import pyarrow as pa
import pytest

import corpus_pipeline
from vacantia.llm import blocks, lines, minhash, quality
from vacantia.llm.texts import worker_state
from vacantia.session import ARROW_BYTES, PYTHON_BATCH


class Rows:
    """Gives the function that would run in the workers."""

    schema = None

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("stage", ["quality", "blocks"])
def test_tables_of_earlier_stages_go(monkeypatch, stage):
    monkeypatch.setattr(blocks, "stage", lambda run, name: run)
    monkeypatch.setattr(blocks.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    worker_state("bpe")["table"] = "large"  # stayed there before
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["word " * 60, None]})
    if stage == "quality":
        rows = list(quality.keep_good(Rows(), quality.RULES[:1])(iter([docs])))
    else:
        rows = list(blocks.packed(Rows(), lambda batch: pa.array([1, 2, 2], pa.uint64()).to_numpy(), "blocks")(iter([docs])))
    assert len(rows) == 1 and worker_state("bpe") == {}


@pytest.mark.parametrize("stage", ["summaries", "shingles", "lines"])
def test_tables_go_when_a_task_is_through(stage):
    worker_state("bpe")["table"] = "large"
    docs = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["word " * 60, None]})
    if stage == "summaries":
        rows = list(minhash.summaries(Rows(), 3, 0.85)(iter([docs])))
    elif stage == "shingles":
        rows = list(minhash.shingle_rows(Rows(), 3)(iter([docs])))
    else:
        rows = list(lines.cut_rows(None)(iter([])))
    assert len(rows) == (stage != "lines") and worker_state("bpe") == {}


def test_stages_bound_what_goes_to_python_at_once(spark):
    before = spark.conf.get(ARROW_BYTES)
    docs = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string")
    try:
        for name, function in corpus_pipeline.STAGES[:3]:
            spark.conf.set(ARROW_BYTES, "1g")
            function(spark, docs, "")
            assert spark.conf.get(ARROW_BYTES) == str(PYTHON_BATCH), name
    finally:
        spark.conf.set(ARROW_BYTES, before)
