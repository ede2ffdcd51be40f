"""Operator 5: byte-pair encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of a word. A sequence of tokens is the true encoding exactly when each
token and each adjacent pair of tokens encodes to itself, so all adjacent pairs of a slice are tested at once, as
numbers looked up among pairs judged before; a pair seen for the first time is judged by merging its own symbols. Only
words with a failing pair are merged symbol by symbol.

Normalisation and the cut into pieces are the tokenizer file's own, so its Unicode tables apply.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.texts import WordTable, encoded, forget_others, slices, worker_state

END = "</w>"
FEW_WORDS, SMALL_BYTES = 150_000, 2 << 20


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class PairCoder:
    """Vocabulary and merges of a tokenizer file with word ends."""

    def __init__(self, text: str, most_judged: int = 1 << 22):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model, library = spec["model"], Tokenizer.from_str(text)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [self.ids[a + b] for a, b in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for string, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = string
        self.inner = {s: i for s, i in self.ids.items() if not (s.endswith(END) and len(s) > len(END))}
        self.final = {s[: -len(END)]: i for s, i in self.ids.items() if s.endswith(END) and len(s) > len(END)}
        self.final_ids = set(self.final.values())
        self.longest = max(map(len, self.final))
        self.reach: dict[str, int] = {}  # by its first two characters, the length of the longest inner token
        for string in self.inner:
            self.reach[string[:2]] = max(self.reach.get(string[:2], 1), len(string))
        self.size = size
        self.most_judged = most_judged  # beyond it pairs are judged anew, which changes no result
        self.judged: dict[int, bool] = {}

    def symbols(self, string: str, ends: bool) -> list[int]:
        out = [self.ids[c] for c in string]
        if ends:
            out[-1] = self.ids[string[-1] + END]
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals, until none is left."""
        if len(ids) > 64:
            return self.merged_by_heap(ids)
        rank_of, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long pieces, whose time then grows little faster than their length."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], right[i] = self.made[rank], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (near := (ids[a], ids[right[a]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[near], a, near))
        return [x for x, there in zip(ids, alive, strict=True) if there]

    def proposal(self, piece: str) -> list[int]:
        """Longest match from left to right."""
        out, i, n = [], 0, len(piece)
        inner, final, longest, reach = self.inner, self.final, self.longest, self.reach
        while i < n:
            if n - i <= longest and (found := final.get(piece[i:])) is not None:
                out.append(found)
                break
            for j in range(min(n - 1, i + reach.get(piece[i : i + 2], 1)), i, -1):
                if (found := inner.get(piece[i:j])) is not None:
                    out.append(found)
                    i = j
                    break
        return out

    def holds(self, key: int) -> bool:
        """Whether a pair of tokens (or a single one, its partner then `size`) encodes to itself."""
        a, b = divmod(key, self.size + 1)
        tokens = [a] if b == self.size else [a, b]
        string = "".join(self.strings[t] for t in tokens)
        ends = string.endswith(END) and tokens[-1] in self.final_ids
        core = string[: -len(END)] if ends else string
        return self.merged(self.symbols(core, ends)) == tokens

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        proposals = [self.proposal(p) for p in pieces]
        if not pieces:
            return []
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        partner = np.append(flat[1:], self.size)
        last = ends - 1
        partner[last] = self.size
        keys = flat * (self.size + 1) + partner
        tested = np.ones(len(keys), bool)
        tested[last[counts > 1]] = False  # the last token of several is covered by its pair
        distinct, where = np.unique(keys[tested], return_inverse=True)
        if len(self.judged) + len(distinct) > self.most_judged:
            self.judged.clear()
        for key in distinct.tolist():
            if key not in self.judged:
                self.judged[key] = self.holds(key)
        good = np.fromiter((self.judged[k] for k in distinct.tolist()), bool, len(distinct))[where]
        failed = np.zeros(len(keys), np.int64)
        failed[tested] = ~good
        wrong = np.add.reduceat(failed, ends - counts) > 0
        for i in np.flatnonzero(wrong).tolist():
            proposals[i] = self.merged(self.symbols(pieces[i], True))
        return proposals

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, strings without ASCII white space, one after the other, and how many each has."""
        plan: list[list[str | int]] = []
        for word in words:
            sections = self.special_pattern.split(word) if self.special and "<|" in word else [word]
            plan.append([])
            for section in sections:
                if section in self.special:
                    plan[-1].append(self.special[section])
                elif section:
                    plan[-1] += [piece for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(section))]
        pieces = list({x for parts in plan for x in parts if isinstance(x, str)})
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        rows = [ids[parts[0]] if len(parts) == 1 and parts[0] in ids else [i for x in parts for i in (ids[x] if isinstance(x, str) else (x,))] for parts in plan]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(counts.sum())), counts


def coder(text: str, most_words: int = 700_000, most_judged: int = 1 << 22) -> tuple[PairCoder, WordTable]:
    """The coder of a tokenizer file and its table of words, built once per Python worker."""
    state = worker_state("bpe")
    if state.get("made_for") != (text, most_words):
        state.clear()
        bpe = PairCoder(text, most_judged)
        state.update(made_for=(text, most_words), coder=bpe, table=WordTable(bpe.encode_words, most_words))
    return state["coder"], state["table"]


def ids_array(ids: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))


def joined(ids: np.ndarray, starts: np.ndarray, strings: pa.Array) -> pa.Array:
    """Decoded texts: the strings of the tokens, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), strings.take(pa.array(ids))), " ")


def encode(docs: DataFrame, tokenizer_path: str, column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """All rows and columns of `docs` and their token ids in a column `into`, which replaces one of that name.

    A column `decoded`, if named, gets the text that the ids decode to, and replaces one of that name likewise. A null or
    empty text has no ids and decodes to an empty text. Rows keep their order within a partition; repeated rows are encoded alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_path))  # one file, a few MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts, ids and decoded texts are all in memory, so tables and slices are small, and those of other stages go.
        forget_others("bpe")
        bpe, table = coder(shared.value, FEW_WORDS, 2 * FEW_WORDS)
        strings = pa.array(bpe.strings)
        for batch in slices(batches, column, SMALL_BYTES):
            ids, starts = encoded(batch.column(column), table)
            columns = {n: batch.column(n) for n in names} | {into: ids_array(ids, starts)}
            if decoded:
                columns[decoded] = joined(ids, starts, strings)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    # The text itself is needed even where the output has no column of its name.
    names = [c for c in docs.columns if c not in (into, decoded)]
    out = docs.select(*names).withColumn(into, F.lit(None).cast("array<int>"))
    return docs.mapInArrow(run, (out.withColumn(decoded, F.lit(None).cast("string")) if decoded else out).schema)


def decode(encoded_docs: DataFrame, tokenizer_path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """All rows with the decoded text in a column `into`; null ids give an empty text, an id outside the vocabulary a failure."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(shared.value)
        strings = pa.array(bpe.strings)
        for batch in batches:
            lists = batch.column(column)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(counts)))
            kept = [n for n in batch.schema.names if n != into]
            texts = joined(lists.flatten().to_numpy(zero_copy_only=False), starts, strings)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), texts], [*kept, into])

    kept = encoded_docs.drop(into)
    return kept.mapInArrow(run, kept.withColumn(into, F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Per row its id, number of tokens and the SHA-256 of ids and of the decoded text, both made in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = coder(shared.value)
        strings = pa.array(bpe.strings)
        for batch in slices(batches, column):
            ids, starts = encoded(batch.column(column), table)
            raw, bounds = memoryview(ids.astype("<u4").tobytes()), (starts * 4).tolist()
            texts = joined(ids, starts, strings)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column),
                    pa.array(np.diff(starts)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]),
                    pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_column), F.col(column))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
