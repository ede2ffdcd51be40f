import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vacantia.session import local_session

    session = local_session(8, shuffle_partitions=4)
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("stage")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def responses(spark):
    """Build an archive from (request_url, body, {other fields})."""
    from pyspark.sql import functions as F

    from vacantia.schemas import RESPONSES

    def make(*rows):
        out = []
        for url, body, *more in rows:
            f = {"render": "http", "final_url": url, "status": 200, "content_type": "text/html", "error": None, "at": 0, **(more[0] if more else {})}
            out.append((url, f["render"], f["final_url"], f["status"], f["content_type"], body, f["error"], f["at"]))
        df = spark.createDataFrame(
            out, "request_url STRING, render STRING, final_url STRING, status INT, content_type STRING, body STRING, error STRING, at INT"
        )
        df = df.withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
        return df.to(spark.createDataFrame([], RESPONSES).schema)

    return make


@pytest.fixture
def companies(spark):
    """Build companies from (slug, website)."""
    from vacantia.schemas import COMPANIES

    def make(*rows):
        return spark.createDataFrame([(0, i, s, str(i), s.upper(), w, None, True) for i, (s, w) in enumerate(rows)], COMPANIES)

    return make
