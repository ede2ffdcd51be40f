"""CSV records by byte ranges against Python's reader and Spark's reader of whole files."""

import csv
import io
import random

import pytest

from vacantia.operators.sinks import CSV_OPTIONS
from vacantia.sources.csv_ranges import ends_inside, lines_of, range_facts, records_of, with_state
from vacantia.sources.shard_csv import merge_shards, read_shards

VALUES = ["", "a", "x y", 'say "hi", he said', "two\nlines", "\r\nthree\n\n", ',"', '"', '""', "é ü", "n" * 300, '","\n","']


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def written(rows, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue().encode()


def by_ranges(data, step):
    f, inside, out = Bytes(data), False, []
    for begin in range(0, len(data), step):
        end = min(begin + step, len(data))
        out += records_of(f, begin, end, inside, len(data))
        inside = ends_inside(lines_of(f, begin, end, len(data))[0], inside)
    return [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in out]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_whatever_the_ranges(end):
    rnd = random.Random(5)
    for _ in range(60):
        rows = [[str(n), rnd.choice(VALUES), rnd.choice(VALUES)] for n in range(rnd.randint(1, 12))]
        data = written(rows, end)
        for cut_off in (data, data.removesuffix(end.encode())):
            for step in (1, 2, 3, 7, 50, 1000, 10**6):
                assert by_ranges(cut_off, step) == rows


def test_quotes_inside_plain_fields_and_open_ends():
    assert by_ranges(b'a,5" pipe\nb,c"d"\n\n  \ne,f\n', 4) == [["a", '5" pipe'], ["b", 'c"d"'], ["e", "f"]]
    for step in (3, 8, 100):
        assert by_ranges(b'a,b\nc,"open\nto the\nend', step) == [["a", "b"], ["c", "open\nto the\nend"]]
    assert by_ranges(b"", 5) == [] and by_ranges(b"\n\n", 1) == []


@pytest.mark.parametrize("range_bytes", [300, 1 << 20])
def test_shards_equal_the_reader_of_whole_files(spark, tmp_path, range_bytes):
    rnd = random.Random(range_bytes)
    rows = [(str(n), rnd.choice(VALUES), rnd.choice(VALUES) + "z") for n in range(300)]
    (tmp_path / "jobs-shard0.csv").write_bytes(written([("a", "b", "c d"), *rows], "\r\n"))
    # A shard of part files with other columns, a short and a long row.
    spark.createDataFrame([(f"p{n}", v) for n, v in enumerate(VALUES)], "a string, x string").repartition(3).write.options(**CSV_OPTIONS).csv(str(tmp_path / "jobs-shard1.csv"))
    (tmp_path / "jobs-shard2.csv").write_bytes(b"\xef\xbb\xbfc d,a\nonly\n1,2,3\n")
    (tmp_path / "jobs-shard3.csv").write_bytes(b"")
    got = read_shards(spark, str(tmp_path / "jobs"), range_bytes=range_bytes)
    assert got.columns == ["a", "b", "c d"]
    want = rows + [(f"p{n}", "", "") for n in range(len(VALUES))] + [("", "", "only"), ("2", "", "1")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # That reader turns line ends inside quotes into plain newlines.
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "jobs-shard0.csv")).na.fill("")
    mine = [tuple(r) for r in got.collect() if r.a.isdigit() and r["c d"].endswith("z")]
    assert sorted(tuple(v.replace("\r\n", "\n") for v in r) for r in mine) == sorted(map(tuple, whole.collect()))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "jobs-shard0.csv").write_bytes(written([("a", "b")] + [(str(n), "x\n" * 40) for n in range(500)], "\n"))
    size = (tmp_path / "jobs-shard0.csv").stat().st_size
    files = spark.createDataFrame([(f"file:{tmp_path}/jobs-shard0.csv", size)], "file string, size long")
    facts = range_facts(files, 4096)
    assert facts.count() == -(-size // 4096) and facts.rdd.getNumPartitions() == facts.count()
    assert 0 < with_state(facts).where("inside").count() < facts.count()
    got = read_shards(spark, str(tmp_path / "jobs"), range_bytes=4096)
    assert got.count() == 500 and got.rdd.getNumPartitions() > 8


def test_names_and_no_header(spark, tmp_path):
    (tmp_path / "d-shard0.csv").write_text('x,,X,"q`""\n,r"\n1,2,3,4\n')
    assert read_shards(spark, str(tmp_path / "d")).columns == ["x0", "_c1", "X2", 'q`"\n,r']
    assert [tuple(r) for r in read_shards(spark, str(tmp_path / "d")).collect()] == [("1", "2", "3", "4")]
    (tmp_path / "e-shard0.csv").write_text("\n \n")
    assert read_shards(spark, str(tmp_path / "e")).count() == 0 and len(read_shards(spark, str(tmp_path / "e")).columns) == 15
    assert merge_shards(spark, str(tmp_path / "f")) is None
