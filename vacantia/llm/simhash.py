"""Operator 12: near-duplicate groups by SimHash and an index of byte positions.

A fingerprint is eight positional bytes. Two that differ in at most four bits differ in at most four bytes, so they
share at least four: the guaranteed minimum of matches. A list of all fingerprints with one positional byte holds
1/256 of the corpus, and tallies over such lists grow with its square; the index therefore lists fingerprints by what
reaches the minimum at once, each choice of four positions with the bytes there. The pairs of a list have their
tally, and are verified by the bits that differ.

Equal fingerprints are one vertex. Lists of two are pairs as they stand. In longer lists the members are joined to the
smallest of those they reach by verified links, so a list gives a row per member at most and never all its pairs. A list
longer than `LONG`, as a large group of near copies makes, is split over tasks by the same index one level down: its
members differ in at most four of the remaining eight half-bytes, so each choice of four of them is a list again, and
with 48 bits fixed such a list has at most 65,536 members.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.components import components
from vacantia.llm.texts import slices
from vacantia.session import stage

BITS, MATCHES = 4, 4
CHOICES = np.array(list(combinations(range(8), MATCHES)))
TEXT_BYTES = 2 << 20
SHINGLES, ROWS = 1 << 12, 1 << 16
LONG = 4096
PAIRS = 1 << 20


def shingle_spans(texts: pa.Array, size: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """Words with A-Z lower-cased, joined by one space; begin and end there of every shingle, and the number of each text."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    lengths = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lower)], pa.int32()), lower), "").cast(pa.binary())[0].as_buffer(), np.uint8)
    blank = (data == 32) | (data >= 9) & (data <= 13)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    before = np.concatenate(([True], blank[:-1])) | first
    begins = ~blank & before
    spaces = blank & ~before  # the first one behind a word stays
    where = np.cumsum(~blank | spaces)
    text = data[~blank | spaces].copy()
    text[np.flatnonzero(spaces[~blank | spaces])] = 32
    begin = where[begins] - 1
    ends = ~blank & (np.concatenate((blank[1:], [True])) | np.concatenate((first[1:], [True])))
    end = where[ends]
    of_word = np.searchsorted(bounds, np.flatnonzero(begins), side="right") - 1
    counts = np.bincount(of_word, minlength=len(lower))
    starts = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(len(begin)) - starts[of_word]
    opens = place <= np.maximum(counts - size, 0)[of_word]
    last = np.arange(len(begin)) + np.minimum(counts, size)[of_word] - 1
    return memoryview(text), begin[opens], end[last[opens]], of_word[opens]


def fingerprints_of(texts: pa.Array, size: int) -> np.ndarray:
    """64-bit SimHash of each text over its shingles, repeats included; zero without words."""
    import xxhash

    text, begin, end, doc = shingle_spans(texts, size)
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros((len(texts), 64), np.int64), np.bincount(doc, minlength=len(texts))
    for at in range(0, len(begin), SHINGLES):
        part = slice(at, at + SHINGLES)
        h = np.fromiter([digest(text[a:b], 42) for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)], "<u8")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(doc[part]) != 0)))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[doc[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(id, fingerprint) of every row (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            found = fingerprints_of(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fingerprint"])

    return docs.mapInArrow(run, "id long, fingerprint long")


def by_bytes(vertices: DataFrame) -> DataFrame:
    """(choice, key, fingerprint): each fingerprint under each choice of four positions, `key` being the bytes there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fingerprint").to_numpy()
            octets = np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8)
            for number, choice in enumerate(CHOICES):
                key = np.ascontiguousarray(octets[:, choice]).view("<i4").reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), number, np.int32)), pa.array(key), batch.column("fingerprint")], ["choice", "key", "fingerprint"])

    return vertices.mapInArrow(run, "choice int, key int, fingerprint long")


def by_half_bytes(rows: DataFrame) -> DataFrame:
    """(choice, key, further, part, fingerprint): the same one level down, over the half-bytes that the choice left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, choice = batch.column("fingerprint").to_numpy(), batch.column("choice").to_numpy()
            octets = np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8)
            rest = np.array([[p for p in range(8) if p not in c] for c in CHOICES.tolist()])[choice]
            left = np.take_along_axis(octets, rest, axis=1)
            halves = np.concatenate((left & 15, left >> 4), axis=1).astype(np.int32)
            for number, c in enumerate(CHOICES):
                part = halves[:, c] @ np.array([1, 16, 256, 4096], np.int32)
                columns = [batch.column("choice"), batch.column("key"), pa.array(np.full(len(f), number, np.int32)), pa.array(part), batch.column("fingerprint")]
                yield pa.RecordBatch.from_arrays(columns, ["choice", "key", "further", "part", "fingerprint"])

    return rows.select("choice", "key", "fingerprint").mapInArrow(run, "choice int, key int, further int, part int, fingerprint long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= BITS


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one it reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def joined_in(members: np.ndarray) -> np.ndarray:
    """The same for the members of one list, each compared once with those not reached before."""
    label, open_ = np.arange(len(members)), np.arange(len(members))
    while len(open_):
        root, front, open_ = open_[0], open_[:1], open_[1:]
        while len(front) and len(open_):
            reached = np.zeros(len(open_), bool)
            step = max(1, PAIRS // len(open_))
            for i in range(0, len(front), step):
                reached |= near(members[front[i : i + step], None], members[open_][None, :]).any(axis=0)
            front, open_ = open_[reached], open_[~reached]
            label[front] = root
    return label


def list_links(starts: np.ndarray, members: np.ndarray, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within the lists members[starts[i]:starts[i + 1]], a row per member at most."""
    lengths = np.diff(starts)
    label = np.arange(len(members))
    for i in np.flatnonzero(lengths > small).tolist():
        a, b = starts[i], starts[i + 1]
        label[a:b] = a + joined_in(members[a:b])
    # Each member of a short list with all behind it.
    short = np.flatnonzero(np.repeat(lengths <= small, lengths))
    behind = np.repeat(starts[1:], lengths)[short] - short - 1
    ends = np.cumsum(behind)
    at = 0
    while at < len(short):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = behind[at:upto]
        x = np.repeat(short[at:upto], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        good = near(members[x], members[y])
        x, y = x[good], y[good]
        # Labels of the members seen so far carry over to the next part.
        label = smallest_reached(len(members), np.concatenate((x, np.arange(len(members)))), np.concatenate((y, label))) if len(x) else label
        at = upto
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[label[moved]], members[moved]


def links_by(rows: DataFrame, keys: list[str], split_long: bool, name: str) -> list[DataFrame]:
    """Tables of links (a, b) between the fingerprints of each list, the rows that `keys` agree on."""
    lists = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    lists = stage(lists.where("n > 1"), f"{name}-lists")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    tables = [lists.where(F.col("n") == 2).where(close).select("a", "b")]
    longer = lists.where("n > 2").select(*keys, "n")
    members = stage(rows.join(longer, keys), f"{name}-members")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(parts: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.any([np.diff(c) != 0 for c in columns], axis=0)
            starts = np.concatenate(([0], np.flatnonzero(change) + 1, [table.num_rows]))
            done = starts if last else starts[:-1]
            held[:] = [] if last else table.slice(int(done[-1])).combine_chunks().to_batches()
            if len(done) > 1:
                a, b = list_links(done, table.column("fingerprint").to_numpy()[: done[-1]].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= ROWS:
                    yield from links(list(held), last=False)
        if held:
            yield from links(list(held), last=True)

    whole = members.where(F.col("n") <= LONG) if split_long else members
    parts = max(1, math.ceil(whole.count() / (1 << 18)))
    tables.append(whole.select(*keys, "fingerprint").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long"))
    if split_long:
        split = members.where(F.col("n") > LONG)
        if not split.isEmpty():
            tables += links_by(by_half_bytes(split), ["choice", "key", "further", "part"], False, f"{name}-half")
    return tables


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, fingerprint (long), component_id (smallest id reachable over links) of every row.

    Texts are linked when their fingerprints over shingles of `size` words differ in four bits or fewer. Null, empty and
    blank texts have the fingerprint zero, which is linked like any other. Rows of one doc_id are one document: they are
    in one component. A null doc_id is linked with nothing and its component is null. Other columns are left out; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    facts = stage(fingerprints(rows, size), "simhash")
    named = facts.where("id IS NOT NULL")
    vertices = stage(named.groupBy("fingerprint").agg(F.min("id").alias("id")), "simhash-vertices")
    tables = links_by(by_bytes(vertices.select("fingerprint")), ["choice", "key"], True, "simhash")
    # Rows of one id with different fingerprints stand for one document.
    several = named.groupBy("id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("high")).where("a < high")
    links = named.join(several, "id").select("a", F.col("fingerprint").alias("b")).where("a <> b")
    for table in tables:
        links = links.union(table)
    found = components(links).withColumnRenamed("id", "fingerprint")
    grouped = vertices.join(found, "fingerprint")
    smallest = grouped.groupBy("component").agg(F.min("id").alias("smallest"))
    moved = stage(grouped.join(smallest, "component").select("fingerprint", "smallest"), "simhash-named")
    alone = vertices.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("smallest", "id").alias("component_id"))
    out = facts.join(stage(alone, "simhash-components"), "fingerprint", "left")
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", component.alias("component_id"))
