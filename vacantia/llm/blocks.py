"""Documents packed in blocks, so that what repeats between blocks is found from hashed keys alone.

A block is one row: some documents, compressed, and the sorted distinct keys of their parts. The keys are cut into shards
by their value, each small enough for one task; a shard tells every block which of its keys other blocks have too.
Texts move only by block. Each block has a key once, so a part that a third of all documents share is no large group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.texts import forget_others, give_back, giving_back, slices
from vacantia.session import stage

KEYS_PER_SHARD = 1 << 20
ABSENT, SHARED, HEAVY = 0, 1, 2

BLOCK = "block long, n_keys long, payload binary, keys binary, counts binary"


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(keys, return_counts=True)
    return found, counts.astype(np.uint32)


def packed(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], name: str) -> DataFrame:
    """Blocks of `docs`, written once. `keys_of` gives the keys of a batch, a key as often as it occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("blocks")
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            keys, counts = distinct_keys(keys_of(batch))
            row = [[block], [len(keys)], [pack(batch)], [pa.compress(keys.tobytes(), "zstd", asbytes=True)], [pa.compress(counts.tobytes(), "zstd", asbytes=True)]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "n_keys", "payload", "keys", "counts"])
            block += 1
        give_back()

    return stage(docs.mapInArrow(run, BLOCK), name)


def numbers(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.empty(0, kind)


def marked(blocks: DataFrame, other_blocks: bool, heavy: int) -> DataFrame:
    """`block`, `payload` and `marks`: for each key of the block, in order, one byte.

    ABSENT: no other block (or, without `other_blocks`, no second part) has it; SHARED: another has it; HEAVY: so have
    more than `heavy` parts. `marks` is null for a block without keys.
    """
    total = blocks.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(1, math.ceil(total / KEYS_PER_SHARD))
    bounds = np.array([i * 2**64 // shards for i in range(1, shards)], np.uint64)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                k, c = numbers(keys, n, "<u8"), numbers(counts, n, "<u4")
                # Of all shards only those that this block has keys of.
                shard = np.searchsorted(bounds, k, side="right")
                ends = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), n]
                rows = [(int(shard[a]), k[a:b].tobytes(), c[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False) if a < b]
                columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "keys", "counts"])

    def judge(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        lengths = [len(b) // 8 for b in blobs]
        keys = np.frombuffer(b"".join(blobs), "<u8")
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        _, where, blocks_with = np.unique(keys, return_inverse=True, return_counts=True)
        parts = np.bincount(where, weights=counts)
        marks = np.where((blocks_with if other_blocks else parts) > 1, np.where(parts > heavy, HEAVY, SHARED), ABSENT).astype(np.uint8)[where]
        ends = np.cumsum([0, *lengths]).tolist()
        packed_marks = [pa.compress(marks[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table([table.column("block"), table.column("shard"), pa.array(lengths, pa.int32()), pa.array(packed_marks, pa.binary())], ["block", "shard", "n", "marks"])

    parts = blocks.select("block", "n_keys", "keys", "counts").mapInArrow(giving_back(cut), "shard int, block long, keys binary, counts binary")
    found = parts.groupBy("shard").applyInArrow(judge, "block long, shard int, n int, marks binary")
    lists = found.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "marks")).alias("marks"))
    return blocks.select("block", "payload").join(lists, "block", "left")


def marks_of(row: list[dict] | None) -> np.ndarray:
    parts = sorted(row or [], key=lambda p: p["shard"])
    return np.concatenate([np.empty(0, np.uint8), *(numbers(p["marks"], p["n"], "u1") for p in parts)])


def marks_of_keys(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The mark of each key of a block, given those of its sorted distinct keys."""
    if not len(marks):
        return np.zeros(len(keys), np.uint8)
    return marks[np.searchsorted(np.unique(keys), keys)]
