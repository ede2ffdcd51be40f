"""Operator 7: repeated passages, found as equal windows of 20 words.

A window is judged where it stands with all windows of the same key. The key is normally the smallest hash among the
window's runs of seven words, which neighbouring windows share, so a whole span of windows moves as one row; where too many parts
have that run in common, it is the window itself. Only windows whose key occurs in several blocks move at all. Groups
are small, so a task lays some of them end to end and numbers the windows by prefix doubling: equal windows have one
number, as suffixes under one node of depth 20 of a suffix tree would; no tree is built. The earliest stays, the
others are removed. Equal windows of one block are settled there beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import blocks as B
from vacantia.llm.texts import Words, codes_of, gather, hashes, mixed, words_of
from vacantia.session import stage

WINDOW = 20
RUN = 7
HEAVY_PARTS = 20_000
GROUP_BYTES = 8 << 20


def nodes(codes: np.ndarray, distinct: int) -> np.ndarray:
    """Number of the tree node of depth WINDOW above each suffix that is long enough, by prefix doubling."""

    def together(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, int]:
        return codes_of(a * max(size, 1) + b)

    n = len(codes)
    if n < WINDOW:
        return np.empty(0, np.int64)
    by_depth = {1: (codes, distinct)}
    for depth in (2, 4, 8, 16):
        half, size = by_depth[depth // 2]
        by_depth[depth] = together(half[: n - depth + 1], half[depth // 2 :][: n - depth + 1], size)
    (deep, size_deep), (rest, size_rest) = by_depth[16], by_depth[4]
    count = n - WINDOW + 1
    return together(deep[:count], rest[16:][:count], max(size_deep, size_rest))[0]


def later(node: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the same node stands above an earlier suffix: of a smaller document, or of the same at a smaller start."""
    order = np.lexsort((start, doc_id))
    first = pd.Series(node[order]).duplicated().to_numpy()
    earliest = order[~first]
    best = np.empty(int(node.max()) + 1 if len(node) else 0, np.int64)
    best[node[earliest]] = earliest
    at = best[node]
    return (doc_id[at] < doc_id) | ((doc_id[at] == doc_id) & (start[at] < start))


@dataclass
class Passages:
    """Windows of the documents of a batch: `at` are word positions, `open` those that no window of the batch precedes."""

    doc_id: np.ndarray
    words: Words
    doc: np.ndarray
    at: np.ndarray
    open: np.ndarray

    def starts_in_doc(self, at: np.ndarray) -> np.ndarray:
        return at - self.words.starts[:-1][self.doc[at]]


def passages(batch: pa.RecordBatch) -> Passages:
    doc_id = pc.fill_null(batch.column("doc_id"), -(2**63)).to_numpy(zero_copy_only=False)
    words = words_of(batch.column("text"))
    doc, n = words.doc_of_word(), len(words.codes)
    at = np.arange(max(n - WINDOW + 1, 0))
    at = at[at + WINDOW <= words.starts[1:][doc[at]]]
    node = nodes(words.codes, len(words.unique))[at]
    start = at - words.starts[:-1][doc[at]]
    return Passages(doc_id, words, doc, at, ~later(codes_of(node)[0], doc_id[doc[at]], start))


def prefixes(p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of each window the smallest hash of its runs of RUN words."""
    of_word = mixed(hashes(p.words.unique))[p.words.codes]
    n = len(of_word)
    if not len(p.at):
        return of_word, np.empty(0, np.uint64)
    run = np.zeros(n - RUN + 1, np.uint64)
    for i in range(RUN):
        run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + of_word[i : i + len(run)])
    smallest = {1: run}
    for depth in (2, 4, 8):
        half = smallest[depth // 2]
        smallest[depth] = np.minimum(half[: -(depth // 2)], half[depth // 2 :])
    runs = WINDOW - RUN + 1
    low = np.minimum(smallest[8][: n - WINDOW + 1], smallest[8][runs - 8 :][: n - WINDOW + 1])
    return of_word, low[p.at]


def window_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The prefixes, mixed: as smallest of several hashes they crowd near zero, and shards are even parts of all numbers."""
    p = passages(batch)
    return mixed(prefixes(p)[1][p.open])


def spans(p: Passages, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the spans that must be compared with other blocks."""
    of_word, key = prefixes(p)
    mark = np.zeros(len(key), np.uint8)
    mark[p.open] = B.marks_of_keys(mixed(key[p.open]), marks)
    heavy = np.flatnonzero(mark == B.HEAVY)
    whole = np.zeros(len(heavy), np.uint64)
    for i in range(WINDOW if len(heavy) else 0):
        whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + of_word[p.at[heavy] + i])
    light = np.flatnonzero(mark == B.SHARED)
    if not len(light):
        return whole, p.at[heavy], np.ones(len(heavy), np.int64)
    at, key = p.at[light], key[light]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (key[1:] != key[:-1]) | (p.doc[at[1:]] != p.doc[at[:-1]]))))
    counts = np.diff(np.append(begins, len(at)))
    return np.concatenate((key[begins], whole)), np.concatenate((at[begins], p.at[heavy])), np.concatenate((counts, np.ones(len(heavy), np.int64)))


SPAN = "key long, block long, row int, doc_id long, start int, windows int, text string"


def span_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, payload, marks in zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "marks")), strict=True):
            p = passages(B.unpack(payload))
            key, at, count = spans(p, B.marks_of(marks))
            for a in range(0, len(key), 20_000):
                k, w, c = key[a : a + 20_000], at[a : a + 20_000], count[a : a + 20_000]
                where, ends = gather(w, c + WINDOW - 1, np.arange(len(w)))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), p.words.unique.take(pa.array(p.words.codes[where]))), " ")
                columns = [k.view(np.int64), np.full(len(k), block), p.doc[w].astype(np.int32), p.doc_id[p.doc[w]], p.starts_in_doc(w).astype(np.int32), c.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), texts], [f.split()[0] for f in SPAN.split(", ")])


def whole_groups(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of about `limit` bytes that hold a key's rows all or not at all."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit and batch.num_rows:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield table.slice(0, end)
            held = table.slice(end).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of set flags; a run ends before a position in `breaks`."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate(([True], (np.diff(at) != 1) | breaks[at[1:]]))
    begins = np.flatnonzero(new)
    return at[begins], at[np.append(begins[1:], len(at)) - 1]


def repeated_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, GROUP_BYTES):
        words = words_of(table.column("text").combine_chunks())
        doc_id, start, count = (table.column(c).to_numpy() for c in ("doc_id", "start", "windows"))
        at, bounds = gather(words.starts[:-1], count.astype(np.int64), np.arange(len(count)))
        span = np.repeat(np.arange(len(count)), count)
        node = codes_of(nodes(words.codes, len(words.unique))[at])[0]
        offset = at - words.starts[:-1][span]
        flags = later(node, doc_id[span], start[span] + offset)
        breaks = np.zeros(len(at), bool)
        breaks[bounds[:-1]] = True
        first, last = runs(flags, breaks)
        s = span[first]
        columns = [table.column("block").to_numpy()[s], table.column("row").to_numpy()[s], (start[s] + offset[first]).astype(np.int32), (start[s] + offset[last] + WINDOW).astype(np.int32)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["block", "row", "begin", "end"])


def remaining(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, repeats in zip(batch.column("payload").to_pylist(), batch.column("repeats"), strict=True):
            rows = B.unpack(payload)
            p = passages(rows)
            change = np.zeros(len(p.words.codes) + 1, np.int64)
            closed = p.at[~p.open]
            np.add.at(change, closed, 1)
            np.add.at(change, closed + WINDOW, -1)
            if repeats.is_valid:
                row, begin, end = (repeats.values.field(c).to_numpy() for c in ("row", "begin", "end"))
                np.add.at(change, p.words.starts[row] + begin, 1)
                np.add.at(change, p.words.starts[row] + end, -1)
            kept = np.cumsum(change)[:-1] == 0
            total = np.concatenate(([0], np.cumsum(kept)))[p.words.starts]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), p.words.unique.take(pa.array(p.words.codes[kept]))), " ")
            n = np.diff(p.words.starts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(n - np.diff(total)), texts], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every row.

    A word goes when a window of WINDOW words over it also starts earlier: in a document of smaller id, or in the same
    document before. Windows are judged on the input. Null, empty and short texts lose nothing. A null id comes before
    all others. Rows of one id are one document; where equal rows repeat, windows at equal starts do not precede each
    other, so all of the rows stay. Other columns are left out; an empty table gives an empty result.
    """
    blocks = B.packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window_keys, "passages")
    found = B.marked(blocks, other_blocks=True, heavy=HEAVY_PARTS).mapInArrow(span_rows, SPAN)
    repeated = found.repartition("key").sortWithinPartitions("key").mapInArrow(repeated_spans, "block long, row int, begin int, end int")
    repeated = stage(repeated, "repeats")
    lists = repeated.groupBy("block").agg(F.collect_list(F.struct("row", "begin", "end")).alias("repeats"))
    joined = blocks.select("block", "payload").join(lists, "block", "left")
    return joined.select("payload", "repeats").mapInArrow(remaining, "doc_id long, n_words long, n_removed long, kept string")
