"""Operator 11: alignment of the tokens of two tokenizers by diagonal run skipping.

Both token sequences of a text cover the same bytes, so each is an increasing array of end offsets. Where the offsets of
both hold the same number, a group of tokens ends. Most groups are one token each: there the arrays agree at a fixed
index shift, a diagonal. `diagonals` compares the arrays at the present shift in stretches that double while they agree
and halve once they do not, so a stretch of n such groups costs about log n comparisons of memory. Where they
disagree, the group is resolved locally by advancing the array that is behind until both meet, which gives the new shift.

A chunk of text between two words is a token border of both tokenizers, so a slice of texts is encoded and resolved into
groups once per distinct chunk, and a worker keeps the tokens of chunks of earlier slices, up to a bound. How often
tokens are linked is counted over the corpus: every slice keeps its pairs with the number of its texts that have them,
Spark sums these by pair, and sends each slice the counts of its own pairs, so no task holds the table of all pairs and a
pair that every text has is one row per slice.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.blocks import pack, unpack
from vacantia.llm.texts import WordTable, codes_of, gather, slices, sums, worker_state
from vacantia.session import stage

TEXT_BYTES = 2 << 20
LARGE_GROUP = 256
ENCODED = 1 << 13
MOST_STRINGS, HELD_BYTES = 300_000, 8 << 20
SPACE_MARK = "▁"


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        self.library = Tokenizer.from_buffer(data)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(data)
        made_of = byte_of_character()
        self.bytes = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for string, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(made_of[c] for c in string) if all(c in made_of for c in string) else string.encode()
        self.splits = spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)

    def encode(self, strings: list[str]) -> list[list[int]]:
        # What the library returns beside the ids is many times their size, so not all of it at once.
        batches = (strings[at : at + ENCODED] for at in range(0, len(strings), ENCODED))
        return [e.ids for batch in batches for e in self.library.encode_batch_fast(batch, add_special_tokens=False)]


class Pieces:
    """Sentence-piece model, which puts a space before a text itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=data)
        n = self.library.vocab_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.splits = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in names)

    def encode(self, strings: list[str]) -> list[list[int]]:
        return self.library.encode([s[1:] for s in strings], num_threads=1)


@dataclass
class Encoder:
    """A tokenizer with the length of each token in bytes, and the ids of strings seen before."""

    tokenizer: ByteLevel | Pieces

    def __post_init__(self):
        self.lengths = np.array([len(b) for b in self.tokenizer.bytes], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.tokenizer.bytes), np.uint8)
        self.table, self.held = WordTable(self.encode_new, MOST_STRINGS), 0

    def encode_new(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings and how many each has: none if its tokens are not made of the string's own bytes."""
        rows = self.tokenizer.encode(strings)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        own = pc.binary_length(pa.array(strings, pa.string())).to_numpy().astype(np.int64)
        self.held += len(data)
        made = sums(self.lengths[ids], np.concatenate(([0], np.cumsum(counts))))
        if not ((made == own).all() and (self.data[gather(self.begins, self.lengths, ids)[0]] == data).all()):
            of = self.tokenizer.bytes
            same = np.fromiter((b"".join(of[i] for i in row) == s.encode() for row, s in zip(rows, strings, strict=True)), bool, len(rows))
            ids, counts = ids[np.repeat(same, counts)], np.where(same, counts, 0)
        return ids, counts

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, and where those of each start. A string that is not made of its tokens' bytes has none."""
        places, table = self.table.look_up(strings), self.table
        at, starts = gather(np.cumsum(table.counts) - table.counts, table.counts, places)
        ids = table.ids[at].astype(np.int64)
        if self.held > HELD_BYTES:  # it starts anew, which changes no result
            table.clear()
            self.held = 0
        return ids, starts


def encoders(first: bytes, second: bytes) -> tuple[Encoder, Encoder]:
    state = worker_state("alignment")
    if state.get("files") != (first, second):
        state.update(files=(first, second), encoders=(Encoder(ByteLevel(first)), Encoder(Pieces(second))))
    return state["encoders"]


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing a token: at their starts, and at a single space between two characters of
    which neither is white space. Of characters beyond ASCII those with a leading byte some white space has (C2, E1 to E3)
    count as such.
    """
    n = len(data)
    plain = (data > 32) & (data < 127)
    lead = (data >= 0xC3) & ~np.isin(data, (0xE1, 0xE2, 0xE3))
    opens = plain | lead  # a character that may follow the space
    # A character that may precede it: its last byte, with the leading byte one, two or three places before.
    closes = plain.copy()
    trail = (data >= 0x80) & (data < 0xC0)
    level = trail
    for back in (1, 2, 3):
        closes[back:] |= level[back:] & lead[:-back]
        level = level & np.concatenate((np.zeros(back, bool), trail[:-back]))[:n]
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 32) & closes[:-2] & opens[2:]
    cut[bounds[:-1]] = True
    ends = bounds[1:-1]
    cut[ends[ends > 0] - 1] = np.isin(ends[ends > 0] - 1, bounds)  # a space that ends a text has nothing behind it
    return np.flatnonzero(cut)


def diagonals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of tokens before its end, in both arrays of end offsets, whose last ends are equal."""
    n, x, y = len(a), a.astype("<i8").tobytes(), b.astype("<i8").tobytes()
    ends_a, ends_b = memoryview(x).cast("q"), memoryview(y).cast("q")
    begin_a, begin_b, length = [], [], []
    i = j = 0
    while i < n:
        done, step = 0, 1
        if ends_a[i] == ends_b[j]:
            done, step = 1, 2
            while i + done + step <= n and x[8 * (i + done) : 8 * (i + done + step)] == y[8 * (j + done) : 8 * (j + done + step)]:
                done += step
                step *= 2
            while step > 1:
                step //= 2
                if i + done + step <= n and x[8 * (i + done) : 8 * (i + done + step)] == y[8 * (j + done) : 8 * (j + done + step)]:
                    done += step
            begin_a.append(i)
            begin_b.append(j)
            length.append(done)
            i += done
            j += done
            if i == n:
                break
        end_a, end_b = ends_a[i], ends_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = ends_a[i]
            else:
                j += 1
                end_b = ends_b[j]
        # A group of several tokens ends as one more step from its last ones.
        begin_a.append(i)
        begin_b.append(j)
        length.append(1)
        i += 1
        j += 1
    starts_a, starts_b, lengths = (np.array(v, np.int64) for v in (begin_a, begin_b, length))
    order = np.arange(len(lengths))
    return gather(starts_a, lengths, order)[0] + 1, gather(starts_b, lengths, order)[0] + 1


@dataclass
class Aligned:
    """Tokens and groups of several texts: text i has the tokens a[starts_a[i]:starts_a[i + 1]], likewise b and groups."""

    a: np.ndarray
    b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    starts_groups: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray


def aligned(texts: pa.Array, first: Encoder, second: Encoder) -> Aligned:
    """Tokens of a space and each text. Those without text, or whose tokens are not made of these bytes, have none."""
    n = len(texts)
    full = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
    some = pc.binary_join_element_wise(" ", texts.filter(pa.array(full)), "")
    bounds = np.concatenate(([0], np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64))))
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "").cast(pa.binary())[0].as_buffer()
    data = np.frombuffer(whole, np.uint8)
    cuts = chunk_starts(data, bounds) if first.tokenizer.splits and second.tokenizer.splits else bounds[:-1]
    offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32).tobytes())
    chunks = pa.StringArray.from_buffers(len(cuts), offsets, whole).dictionary_encode()
    codes = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    strings = chunks.dictionary.to_pylist()
    doc = np.flatnonzero(full)[np.searchsorted(bounds, cuts, side="right") - 1]
    tables = [e.encode(strings) for e in (first, second)]
    right = (np.diff(tables[0][1]) > 0) & (np.diff(tables[1][1]) > 0)
    wrong = np.zeros(n, bool)
    wrong[doc[~right[codes]]] = True
    codes, doc = codes[~wrong[doc]], doc[~wrong[doc]]
    # Groups end with every chunk, so those of the distinct chunks are found once and laid out in text order like the tokens.
    kept = np.flatnonzero(right)
    flat, starts, ends = [], [], []
    for encoder, (ids, at) in zip((first, second), tables, strict=True):
        counts = np.diff(at)
        flat.append(ids[gather(at[:-1], counts, codes)[0]])
        starts.append(np.concatenate(([0], np.cumsum(np.bincount(doc, weights=counts[codes], minlength=n).astype(np.int64)))))
        ends.append(np.cumsum(encoder.lengths[ids[gather(at[:-1], counts, kept)[0]]]))
    group_a, group_b = diagonals(*ends)
    groups = np.zeros(len(right), np.int64)
    groups[kept] = np.diff(np.searchsorted(group_a, np.cumsum(np.diff(tables[0][1])[kept]), side="right"), prepend=0)
    places, _ = gather(np.cumsum(groups) - groups, groups, codes)
    starts_groups = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=groups[codes], minlength=n).astype(np.int64))))
    return Aligned(*flat, *starts, starts_groups, np.diff(group_a, prepend=0)[places], np.diff(group_b, prepend=0)[places])


def group_texts(x: Aligned) -> pa.Array:
    """Groups of each text as `a1,a2|b1;a3|b2,b3`."""
    def written(ids: np.ndarray, last: np.ndarray, between: str, behind: str) -> pa.Array:
        there = np.bincount(ids) > 0
        distinct, at = np.flatnonzero(there), (np.cumsum(there) - 1)[ids]
        strings = pa.array([f"{i}{between}" for i in distinct.tolist()] + [f"{i}{behind}" for i in distinct.tolist()], pa.string())
        return strings.take(pa.array(at + len(distinct) * last))

    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[np.cumsum(x.sizes_a) - 1] = 1
    last_b[np.cumsum(x.sizes_b) - 1] = 1
    both = pa.concat_arrays([written(x.a, last_a, ",", "|"), written(x.b, last_b, ",", ";")])
    # The tokens of each group, first those of one tokenizer, then of the other.
    sizes = np.stack((x.sizes_a, x.sizes_b), axis=1).reshape(-1)
    begins = np.stack((np.cumsum(x.sizes_a) - x.sizes_a, len(x.a) + np.cumsum(x.sizes_b) - x.sizes_b), axis=1).reshape(-1)
    order, _ = gather(begins, sizes, np.arange(len(sizes)))
    lists = pa.ListArray.from_arrays(pa.array((x.starts_a + x.starts_b).astype(np.int32)), both.take(pa.array(order)))
    return pc.utf8_rtrim(pc.binary_join(lists, ""), ";")


def link_rows(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair (the first id in the high half) and number of its links; a pair may have several rows."""
    texts = np.repeat(np.arange(len(x.starts_groups) - 1), np.diff(x.starts_groups))
    begin_a, begin_b = np.cumsum(x.sizes_a) - x.sizes_a, np.cumsum(x.sizes_b) - x.sizes_b
    products = x.sizes_a * x.sizes_b
    small = np.flatnonzero(products <= LARGE_GROUP)
    n = products[small]
    group = np.repeat(small, n)
    inner = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    pair = x.a[begin_a[group] + inner // x.sizes_b[group]] << 32 | x.b[begin_b[group] + inner % x.sizes_b[group]]
    out = [(texts[group], pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(products > LARGE_GROUP).tolist():  # a row per pair of distinct ids
        ids_a, n_a = np.unique(x.a[begin_a[g] : begin_a[g] + x.sizes_a[g]], return_counts=True)
        ids_b, n_b = np.unique(x.b[begin_b[g] : begin_b[g] + x.sizes_b[g]], return_counts=True)
        pairs = (ids_a[:, None] << 32 | ids_b[None, :]).reshape(-1)
        out.append((np.full(len(pairs), texts[g]), pairs, (n_a[:, None] * n_b[None, :]).reshape(-1)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pair_lists(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, in how many texts each is; for each text and pair of it, in text order, the pair's number and its
    links; and where the entries of each text start.
    """
    doc, pair, links = link_rows(x)
    distinct, codes = np.unique(pair, return_inverse=True) if len(pair) < 1 << 12 else sorted_codes(pair)
    entry, n = codes_of(doc * max(len(distinct), 1) + codes)
    weights = np.bincount(entry, weights=links, minlength=n).astype(np.int64)
    head = np.zeros(n, np.int64)
    head[entry[::-1]] = np.arange(len(entry))[::-1]
    order = np.argsort(doc[head], kind="stable")
    entry_doc, number = doc[head][order], codes[head][order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(entry_doc, minlength=len(x.starts_a) - 1))))
    return distinct, np.bincount(number, minlength=len(distinct)), number, weights[order], starts


def sorted_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse, by hashing: only the distinct values are sorted."""
    codes, n = codes_of(values)
    head = np.zeros(n, np.int64)
    head[codes[::-1]] = np.arange(len(codes))[::-1]
    order = np.argsort(values[head])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return values[head][order], rank[codes]


def pressed(numbers: np.ndarray, kind: str) -> bytes:
    return pa.compress(numbers.astype(kind).tobytes(), "zstd", asbytes=True)


def unpressed(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.empty(0, kind)


def align(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", column: str = "text", groups: str = "text") -> DataFrame:
    """Per row its id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups.

    `byte_level` and `pieces` name the files of the two tokenizers. `groups` is "text" for a column `groups` as
    `a1,a2|b1;a3|b2,b3`, or "sha256" for `groups_sha256`, its hash. A text is encoded with a space before it. Links are all
    pairs of tokens of one group; the count of a pair of ids is the number of rows that have it linked; n_best are
    the links whose count is the highest of their first id, ties included; count_sum is the sum of counts over the links.

    Null and empty texts, and those whose tokens are not made of their bytes, have no tokens: zeros and an empty string.
    Repeated rows and rows with a null id count as rows of their own; an empty table gives an empty result; other
    columns are left out. A group is resolved whole, however long; of a long one pairs of distinct ids are kept, not of tokens.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups are given as text or as sha256")
    name = "groups" if groups == "text" else "groups_sha256"
    files = docs.sparkSession.sparkContext.broadcast((file_bytes(byte_level), file_bytes(pieces)))  # two files, a few MB

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_a, encoder_b = encoders(*files.value)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, column, TEXT_BYTES):
            x = aligned(batch.column(column), encoder_a, encoder_b)
            spelled = group_texts(x)
            if groups == "sha256":
                spelled = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() if len(t.as_buffer()) else "" for t in spelled], pa.string())
            pairs, texts, numbers, links, starts = pair_lists(x)
            products = np.concatenate(([0], np.cumsum(x.sizes_a * x.sizes_b)))[x.starts_groups]
            kept = [batch.column(id_column), *(pa.array(np.diff(v)) for v in (x.starts_a, x.starts_b, x.starts_groups, products)), spelled, pa.array(np.diff(starts))]
            payload = pack(pa.RecordBatch.from_arrays(kept, ["doc_id", "n_a", "n_b", "n_groups", "n_links", name, "entries"]))
            row = [[block], [len(numbers)], [payload], [pressed(numbers, "<u4")], [pressed(links, "<u4")], [len(pairs)], [pressed(pairs, "<i8")], [pressed(texts, "<u4")]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "entries", "payload", "numbers", "links", "n", "pairs", "texts"])
            block += 1

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, pairs, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "pairs", "texts")), strict=True):
                columns = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(unpressed(pairs, n, "<i8")), pa.array(unpressed(texts, n, "<u4").astype(np.int32))]
                yield from pa.Table.from_arrays(columns, ["block", "place", "pair", "texts"]).to_batches(max_chunksize=1 << 16)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("entries", "payload", "numbers", "links", "n")}
        count, best = np.zeros(row["n"], np.int64), np.zeros(row["n"], np.int64)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        batch = unpack(row["payload"])
        numbers, links = unpressed(row["numbers"], row["entries"], "<u4"), unpressed(row["links"], row["entries"], "<u4").astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(batch.column("entries").to_numpy())))
        sums = [np.concatenate(([0], np.cumsum(links * v[numbers])))[starts] for v in (best, count)]
        columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(np.diff(v)) for v in sums] + [batch.column(name)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", name])

    rows = docs.select(F.col(id_column), F.col(column))
    kind = rows.schema[id_column].dataType.simpleString()
    blocks = stage(rows.mapInArrow(encode, "block long, entries long, payload binary, numbers binary, links binary, n long, pairs binary, texts binary"), "align-blocks")
    pairs = blocks.select("block", "n", "pairs", "texts").mapInArrow(listed, "block long, place int, pair long, texts int")
    counts = pairs.groupBy("pair").agg(F.sum("texts").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = stage(counts, "align-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    values = pairs.join(judged, "pair").select("block", "place", "count", "best")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {name} string"
    entries = blocks.select("block", "entries", "payload", "numbers", "links", "n")
    return entries.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(scored, schema)
