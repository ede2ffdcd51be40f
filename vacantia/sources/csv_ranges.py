"""Records of CSV files, a byte range per task.

A newline ends a record only outside quotes, and whether a range begins inside quotes depends on all that is before it.
So a first pass tells of each range how it ends if it begins outside and if it begins inside quotes; these short rows
are put in a row per file; a second pass reads the records that begin in each range, the last one to its end beyond it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

RANGE_BYTES = 32 << 20
# More ranges than this share tasks.
MOST_TASKS = 50_000
_STEP = 1 << 16
_BATCH_BYTES = 4 << 20


def open_file(address: str):
    """A file of a store that Arrow knows by address, for reading at any place."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + address[5:].lstrip("/"))
    system, path = fs.FileSystem.from_uri(quote(address, safe=":/@"))
    return system.open_input_file(path)


def _next_line(file, at: int, size: int) -> int:
    """Where the first line begins that does not begin before `at`."""
    if at <= 0:
        return 0
    at -= 1
    while at < size:
        data = file.read_at(min(_STEP, size - at), at)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return size


def lines_of(file, begin: int, end: int, size: int) -> tuple[bytes, int]:
    """The lines that begin in the range, and where the line after them begins."""
    first = _next_line(file, begin, size)
    if first >= end:
        return b"", first
    last = _next_line(file, end, size)
    return file.read_at(last - first, first), last


def ends_inside(data: bytes, inside: bool, at: int = 0) -> bool:
    """Whether whole lines end within quotes. Quotes open at the beginning of a field only; two of them within quotes are one."""
    for _, inside in _quotes(data, inside, at):
        pass
    return inside


def _quotes(data: bytes, inside: bool, at: int = 0) -> Iterator[tuple[int, bool]]:
    """Places where quotes open and close, in turn, with the state after them."""
    while True:
        found = data.find(b'"', at)
        if found < 0:
            return
        at = found + 1
        if inside:
            if data[at : at + 1] == b'"':
                at += 1
                continue
            inside = False
        elif found == 0 or data[found - 1] in b",\r\n":
            inside = True
        else:
            continue
        yield found, inside


def cut(data: bytes, inside: bool) -> tuple[list[bytes], bytes | None]:
    """Records that begin and end in whole lines, and the beginning of one that does not end. One begun before them is left out."""
    out: list[bytes] = []
    # A record begun before has no beginning here.
    begin = None if inside else 0
    at = 0
    for place, after in chain(_quotes(data, inside), [(len(data), inside)]):
        # Outside quotes, up to the next opening one, line ends are ends of records.
        while not inside and (found := data.find(b"\n", at, place)) >= 0:
            if begin is not None:
                out.append(data[begin:found])
            begin = at = found + 1
        at, inside = place, after
    return out, (data[begin:] if begin is not None and begin < len(data) else None)


def records_of(file, begin: int, end: int, inside: bool, size: int) -> Iterator[bytes]:
    """Records that begin in the range; blank ones are left out."""
    data, after = lines_of(file, begin, end, size)
    whole, rest = cut(data, inside)
    yield from (r for r in (w.removesuffix(b"\r") for w in whole) if r.strip())
    if rest is not None:
        pieces, is_open = [rest], ends_inside(rest, False)
        while is_open and after < size:
            data, after = lines_of(file, after, min(after + _STEP, size), size)
            piece, is_open = _until_closed(data)
            pieces.append(piece)
        if (record := b"".join(pieces).removesuffix(b"\r")).strip():
            yield record


def _until_closed(data: bytes) -> tuple[bytes, bool]:
    """Lines up to the end of the record they begin within, and whether it is open after them."""
    at, inside = 0, True
    for place, after in chain(_quotes(data, True), [(len(data), True)]):
        if not inside and (found := data.find(b"\n", at, place)) >= 0:
            return data[:found], False
        at, was, inside = place, inside, after
    return data, was


FACTS = "file string, size long, begin long, end long, after_outside boolean, after_inside boolean, header binary"


def range_facts(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of the files (file, size), how they end, and of first ranges the first record."""
    n = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("size > 0").select("file", "size", begins.alias("begin"))
    ranges = ranges.withColumn("end", F.least("size", F.col("begin") + range_bytes)).repartition(min(int(n), MOST_TASKS), "file", "begin")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with open_file(file) as f:
                    data, _ = lines_of(f, begin, end, size)
                    first = (r for stop in (min(_STEP, end), end) for r in records_of(f, 0, stop, False, size)) if begin == 0 else iter(())
                    header = next(first, None)
                rows.append((file, size, begin, end, ends_inside(data, False), ends_inside(data, True), header))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in FACTS.split(", ")])

    return ranges.mapInArrow(run, FACTS)


def with_state(facts: DataFrame) -> DataFrame:
    """Ranges with `inside`: whether they begin within quotes. One short row per range of a file meets in a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        inside, out = False, []
        for after in zip(table.column("after_outside").to_pylist(), table.column("after_inside").to_pylist(), strict=True):
            out.append(inside)
            inside = after[inside]
        return table.select(["file", "size", "begin", "end"]).append_column("inside", pa.array(out, pa.bool_()))

    kept = facts.select("file", "size", "begin", "end", "after_outside", "after_inside")
    return kept.groupBy("file").applyInArrow(run, "file string, size long, begin long, end long, inside boolean")


def records(ranges: DataFrame) -> DataFrame:
    """`record`: the text of every record of the ranges but the first one of each file, which is its header."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
        for batch in batches:
            for file, size, begin, end, inside in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                with open_file(file) as f:
                    found = records_of(f, begin, end, inside, size)
                    if begin == 0:
                        next(found, None)
                    rows, held = [], 0
                    for r in found:
                        rows.append(r)
                        held += len(r)
                        if held >= _BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    return ranges.select("file", "size", "begin", "end", "inside").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
