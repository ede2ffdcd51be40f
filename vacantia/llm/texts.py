"""Words of whole texts in Arrow batches, cut into slices of bounded size.

A word is a run of characters other than space and U+0009 to U+000D. A null text has none.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for tables that are costly to build."""
    return sys.modules.setdefault(f"vacantia_worker_{name}", types.ModuleType(name)).__dict__.setdefault("state", {})


def forget_others(name: str) -> None:
    """Drop the tables that earlier stages left in this worker."""
    for key in [k for k in sys.modules if k.startswith("vacantia_worker_") and k != f"vacantia_worker_{name}"]:
        sys.modules[key].__dict__.get("state", {}).clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as an idle Python worker stays beside those of later jobs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches; when it is through, tables of earlier stages and freed memory leave the worker."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        forget_others("")

    return whole


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


@dataclass
class Words:
    """Words of several texts: text i has the words codes[starts[i]:starts[i + 1]], each a position in `unique`."""

    starts: np.ndarray
    codes: np.ndarray
    unique: pa.Array

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def words_of(texts: pa.Array) -> Words:
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if blank.any():
        counts[blank] = 0
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    return Words(np.concatenate(([0], np.cumsum(counts))), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of `values` in each range between neighbouring starts; 0 for an empty range."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def codes_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each value among the distinct ones, and how many are distinct."""
    codes, distinct = pd.factorize(values)
    return codes.astype(np.int64), len(distinct)


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one mixing of 64-bit numbers (the finaliser of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    if not len(strings):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def gather(starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges `order` laid end to end, and the start of each of them in the result."""
    chosen = lengths[order]
    at = np.concatenate(([0], np.cumsum(chosen)))
    return np.repeat(starts[order] - at[:-1], chosen) + np.arange(at[-1]), at


class WordTable:
    """Token ids of words seen before; at most `most` words, beyond which it starts anew, which changes no result.

    `encode_new` gives the ids of a list of words, one after the other, and how many each has.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 700_000):
        self.encode_new, self.most = encode_new, most
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.places) + len(words) > self.most and self.places:
            self.clear()
        new = [w for w in words if w not in self.places]
        if new:
            ids, counts = self.encode_new(new)
            self.places.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
            self.ids, self.counts = np.concatenate((self.ids, ids.astype(np.uint32))), np.concatenate((self.counts, counts))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def encoded(texts: pa.Array, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and where those of each text start.

    For tokenizers whose tokens never span white space: each distinct word is encoded once. Commas and stops behind an
    ASCII letter or digit are split off, and ASCII words are lower-cased before the lookup; the tokenizer's own rules do
    both.
    """
    words = words_of(texts)
    core = pc.utf8_rtrim(words.unique, ",.")
    splits = pc.match_substring_regex(core, "[0-9A-Za-z]$")
    core = pc.if_else(splits, core, words.unique)
    lowers = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<|")))
    core = pc.if_else(lowers, pc.ascii_lower(core), core).dictionary_encode()
    tail = pc.replace_substring_regex(pc.if_else(splits, words.unique, ""), "^.*[0-9A-Za-z]", "").dictionary_encode()
    place = table.look_up(core.dictionary.to_pylist() + [t for t in tail.dictionary.to_pylist()])
    n = len(core.dictionary)
    pair = np.stack((place[:n][core.indices.to_numpy()], place[n:][tail.indices.to_numpy()]), axis=1)
    starts = np.concatenate(([0], np.cumsum(table.counts)))[:-1]
    at, part_starts = gather(starts, table.counts, pair[words.codes].reshape(-1))
    return table.ids[at], part_starts[2 * words.starts]
