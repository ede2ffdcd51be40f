"""An interpolated modified Kneser-Ney model of word n-grams, counted and looked up by joins on hashed keys.

Documents are packed in blocks of bounded size. A symbol is the hash of a language and a word; words seen less than
MIN_COUNT times in all trusted text of their language share one symbol, so the vocabulary is known before grams are
counted. Every block reduces its text to distinct grams before anything moves. Counts, continuation counts and contexts
are aggregated by gram in Spark and never collected. For scoring, the sorted keys of each block's distinct grams are cut into
shards by their first bits and packed, joined by shard with the finished table, and what was found returns packed to the
block, so a task holds one block and its own grams, or one shard of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.blocks import pack, unpack
from vacantia.llm.texts import codes_of, hashes, mixed, slices, words_of
from vacantia.session import stage

ORDER = 3
MIN_COUNT = 2
BLOCK_BYTES = 2 << 20
#: Symbols that no word has: before and behind a text, a word outside the vocabulary, and the language itself.
BEGIN, END, UNKNOWN, LANGUAGE = range(1, 5)
GRAM, CONTEXT, EVEN = range(3)
#: About as many distinct grams a block has, and a shard has keys of all blocks.
KEYS_PER_BLOCK, KEYS_PER_SHARD = 1 << 19, 1 << 20

#: How an intermediate table is written.
Write = Callable[[DataFrame, str], DataFrame]


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from the numbers of grams seen one to four times."""
    n = [0, *counts.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5))).first()]
    if not n[1] or not n[2]:
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    found = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


def marks_of_language(names: pa.Array, which: int) -> np.ndarray:
    """The symbol `which` of each language."""
    return mixed(mixed(hashes(names)) + np.uint64(which))


def symbols_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Words of a block: (starts, number of each word, symbols, texts and languages of the distinct ones, language of each text, names)."""
    coded = pc.fill_null(batch.column("lang"), "").dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = words_of(batch.column("text"))
    size = max(1, len(words.unique))
    pair = lang[words.doc_of_word()] * size + words.codes
    number, distinct = codes_of(pair)
    of_pair = np.zeros(distinct, np.int64)
    of_pair[number] = pair
    symbol = mixed(hashes(words.unique)[of_pair % size] + mixed(hashes(coded.dictionary))[of_pair // size]) if distinct else np.empty(0, np.uint64)
    return words.starts, number, symbol, words.unique.take(pa.array(of_pair % size)), of_pair // size, lang, coded.dictionary


def blocks_of(docs: DataFrame, write: Write = stage) -> DataFrame:
    """(block, payload), written once, of doc_id, text, lang and train."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(batch)], pa.binary())], ["block", "payload"])
            block += 1

    return write(docs.select("doc_id", "text", "lang", "train").mapInArrow(run, "block long, payload binary"), "text-blocks")


def word_uses(blocks: DataFrame, write: Write = stage) -> DataFrame:
    """(block, symbol, lang, word, c): the distinct words of each block and how often its training texts have them; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                rows = unpack(payload)
                starts, number, symbol, word, of_lang, _, names = symbols_of(rows)
                train = np.repeat(rows.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts))
                counts = np.bincount(number[train], minlength=len(symbol))
                columns = [np.full(len(symbol), block), symbol.view(np.int64), names.take(pa.array(of_lang)), word, counts]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["block", "symbol", "lang", "word", "c"])

    return write(blocks.mapInArrow(run, "block long, symbol long, lang string, word string, c long"), "word-uses")


CODED = "block long, docs binary, symbols binary, words binary"


def coded_blocks(blocks: DataFrame, unknown: DataFrame, write: Write = stage) -> DataFrame:
    """Blocks as symbols instead of text, written once. `unknown` has (block, symbol, spelled): words outside the vocabulary and the log
    probability of their spelling."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        columns = {name: [] for name in ("block", "docs", "symbols", "words")}
        for number_of_block, payload in zip(block.column("block").to_pylist(), block.column("payload").to_pylist(), strict=True):
            rows = unpack(payload)
            starts, number, symbol, _, of_lang, lang, names = symbols_of(rows)
            told = found.column("symbol").to_numpy().view(np.uint64)
            order = np.argsort(told)
            told, spelled = told[order], found.column("spelled").to_numpy()[order]
            at = np.minimum(np.searchsorted(told, symbol), max(0, len(told) - 1))
            strange = told[at] == symbol if len(told) else np.zeros(len(symbol), bool)
            cost = np.where(strange, spelled[at], 0.0) if len(told) else np.zeros(len(symbol))
            symbol = np.where(strange, marks_of_language(names, UNKNOWN)[of_lang], symbol) if len(symbol) else symbol
            doc = np.repeat(np.arange(rows.num_rows), np.diff(starts))
            per_doc = {"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "train": rows.column("train")}
            per_doc |= {"n_chars": pc.fill_null(pc.utf8_length(rows.column("text")), 0).cast(pa.int64())}
            per_doc |= {"n_words": pa.array(np.diff(starts)), "spelled": pa.array(np.bincount(doc, cost[number], rows.num_rows))}
            columns["block"].append(number_of_block)
            columns["docs"].append(pack(pa.RecordBatch.from_pydict(per_doc)))
            columns["symbols"].append(pack(pa.RecordBatch.from_pydict({"symbol": pa.array(symbol)})))
            columns["words"].append(pack(pa.RecordBatch.from_pydict({"number": pa.array(number.astype(np.int32))})))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], list(columns))

    joined = blocks.groupBy("block").cogroup(unknown.groupBy("block")).applyInArrow(run, CODED)
    return write(joined, "coded-blocks")


class Sequences:
    """Symbols of the texts of a block, one after the other, each with ORDER - 1 marks before and one behind it.

    `table[n]` has the distinct grams of n symbols as rows of `ORDER` columns, zeros in front; `number[n]` names the gram that ends at
    each place of `ends`, and `context[n]` the one of n symbols before it. `language` is the place of each text's language in `table[1]`.
    """

    def __init__(self, docs: pa.RecordBatch, symbols: np.ndarray, words: np.ndarray, chosen: np.ndarray):
        coded = docs.column("lang").dictionary_encode()
        lang, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        n_words = docs.column("n_words").to_numpy().astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(n_words)))
        marks = [marks_of_language(names, which) for which in (BEGIN, END, LANGUAGE)]
        local, size = codes_of(np.concatenate((symbols, *marks)))
        alphabet = np.zeros(size, np.uint64)
        alphabet[local] = np.concatenate((symbols, *marks))
        begin, end, self_ = np.split(local[len(symbols) :], 3)
        lengths = n_words[chosen] + ORDER
        at = np.cumsum(lengths) - lengths
        sequence = np.empty(int(lengths.sum()), np.int64)
        inside = np.ones(len(sequence), bool)
        for i in range(ORDER - 1):
            sequence[at + i] = begin[lang[chosen]]
            inside[at + i] = False
        sequence[at + lengths - 1] = end[lang[chosen]]
        place = np.flatnonzero(inside & ~np.isin(np.arange(len(sequence)), at + lengths - 1))
        picked = np.repeat(starts[chosen] - np.concatenate(([0], np.cumsum(n_words[chosen])))[:-1], n_words[chosen]) + np.arange(int(n_words[chosen].sum()))
        sequence[place] = local[words[picked]]
        self.ends = np.flatnonzero(inside)
        self.doc = np.repeat(np.arange(len(chosen)), n_words[chosen] + 1)
        self.language = self_[lang[chosen]]
        self.names, self.lang = names, lang[chosen]
        self.table = {1: np.stack([np.zeros(size, np.uint64)] * (ORDER - 1) + [alphabet], axis=1)}
        self.number, whole = {1: sequence[self.ends]}, {1: sequence}
        self.context = {0: self.language[self.doc]}
        for n in range(2, ORDER + 1):
            # Grams that reach over the start of the first text are left at the gram of its first symbols.
            before = np.concatenate((whole[n - 1][:1], whole[n - 1][:-1]))
            codes, distinct = codes_of(before * size + sequence)
            if n == ORDER:
                codes, distinct = codes_of((before * size + sequence)[self.ends])
                whole[n], places = codes, self.ends
            else:
                whole[n], places = codes, np.arange(len(sequence))
            sample = np.zeros(distinct, np.int64)
            sample[codes] = places
            grams = [np.zeros(distinct, np.uint64)] * (ORDER - n) + [alphabet[sequence[np.maximum(sample - back, 0)]] for back in range(n - 1, -1, -1)]
            self.table[n] = np.stack(grams, axis=1) if distinct else np.empty((0, ORDER), np.uint64)
            self.number[n] = codes if n == ORDER else codes[self.ends]
        for n in range(1, ORDER):
            self.context[n] = whole[n][self.ends - 1]


def sequences(docs: bytes, symbols: bytes, words: bytes, train: bool) -> tuple[Sequences, pa.RecordBatch]:
    rows = unpack(docs)
    chosen = np.flatnonzero(rows.column("train").to_numpy(zero_copy_only=False)) if train else np.arange(rows.num_rows)
    return Sequences(rows, unpack(symbols).column("symbol").to_numpy(), unpack(words).column("number").to_numpy(), chosen), rows


NAMES = [f"g{i}" for i in range(ORDER)]
GRAMS = ", ".join(f"{n} long" for n in NAMES)


def gram_counts(coded: DataFrame, write: Write = stage) -> DataFrame:
    """(lang, g0, g1, ..., c) of the training texts, summed per block before the shuffle; `lang` is the language's symbol."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["docs", "symbols", "words"]).to_pylist():
                x, _ = sequences(**row, train=True)
                grams, number = x.table[ORDER], x.number[ORDER]
                language = np.zeros(len(grams), np.uint64)
                language[number] = x.table[1][x.context[0], -1]
                columns = [language, *grams.T, np.bincount(number, minlength=len(grams))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], ["lang", *NAMES, "c"])

    rows = coded.mapInArrow(run, f"lang long, {GRAMS}, c long")
    return write(rows.groupBy("lang", *NAMES).agg(F.sum("c").alias("c")), "word-grams")


def key_of(columns: list[Column]) -> Column:
    return F.xxhash64(*[F.lit(0).cast("long")] * (ORDER - len(columns)), *columns)


def model_of(counts: DataFrame, write: Write = stage, write_level: Write = stage) -> DataFrame:
    """(key, kind, x, y): the discounted count of a gram; the count of a context and the share that was taken off what follows
    it; or the even probability of any word of a language. Written once."""
    out, level = None, counts
    for size in range(ORDER, 0, -1):
        names = NAMES[ORDER - size :]
        d = discounts(level)
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = level.select("lang", *names, "c", taken.alias("taken"))
        found = seen.select(key_of([F.col(n) for n in names]).alias("key"), F.lit(GRAM).alias("kind"), (F.col("c") - F.col("taken")).alias("x"), F.lit(0.0).alias("y"))
        before = names[:-1] or ["lang"]
        contexts = seen.groupBy(*before).agg(F.sum("c").cast("double").alias("x"), (F.sum("taken") / F.sum("c")).alias("y"))
        found = found.union(contexts.select(key_of([F.col(n) for n in before]), F.lit(CONTEXT), "x", "y"))
        if size == 1:
            found = found.union(seen.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("x")).select(key_of([F.col("lang")]), F.lit(EVEN), "x", F.lit(0.0)))
        else:
            level = write_level(seen.groupBy("lang", *names[1:]).agg(F.count("*").alias("c")), "word-grams")
        out = found if out is None else out.union(found)
    return write(out, "word-model")


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def keys_of(grams: np.ndarray) -> np.ndarray:
    """What `key_of` gives in Spark, for rows of symbols: XXH64 of one after the other, each with the hash before as its seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    out = np.full(len(grams), 42, np.uint64)
    for column in grams.T:
        out = (out + p5 + np.uint64(8)) ^ turned(column * p2, 31) * p1
        out = turned(out, 27) * p1 + p4
        out = (out ^ out >> np.uint64(33)) * p2
        out = (out ^ out >> np.uint64(29)) * p3
        out ^= out >> np.uint64(32)
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers, compressed with their first bytes together, then their second, and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def grams_of(x: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the distinct grams of a block, and which gram each is, those of one symbol first."""
    keys = keys_of(np.concatenate([x.table[n] for n in range(1, ORDER + 1)]))
    order = np.argsort(keys)
    return keys[order], order


def wanted_grams(coded: DataFrame, bits: int) -> DataFrame:
    """(shard, block, n, keys): the keys of the distinct grams of each block, by their first `bits` bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = row.pop("block")
                keys, _ = grams_of(sequences(**row, train=False)[0])
                shard = keys >> np.uint64(64 - bits)
                ends = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
                rows = [(int(shard[a]), b - a, packed(np.diff(keys[a:b], prepend=np.uint64(0)))) for a, b in zip(ends, ends[1:], strict=False) if a < b]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "n", "keys"])

    return coded.mapInArrow(run, "shard long, block long, n int, keys binary")


KINDS = {"gram": GRAM, "context": CONTEXT, "even": EVEN}
FOUND = "block long, shard long, n int, " + ", ".join(f"{name}_n int, {name} binary, {name}_x binary, {name}_y binary" for name in KINDS)


def found_grams(wanted: DataFrame, model: DataFrame, bits: int) -> DataFrame:
    """Per block and shard, for each key sent to it, in order, what the model has of each kind, zeros if nothing: the number of a pair
    of values, and the distinct pairs, which are few."""

    def run(wanted: pa.Table, model: pa.Table) -> pa.Table:
        sizes = wanted.column("n").to_pylist()
        keys = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(unpacked(k, n, "<u8"), dtype=np.uint64) for k, n in zip(wanted.column("keys").to_pylist(), sizes, strict=True))])
        known, kind = model.column("key").to_numpy().view(np.uint64), model.column("kind").to_numpy()
        x, y = (np.append(model.column(c).to_numpy(), 0.0) for c in ("x", "y"))
        (number_x, _), (number_y, several) = codes_of(x), codes_of(y)
        pair = number_x * several + number_y
        ends = np.cumsum([0, *sizes]).tolist()
        out = {c: wanted.column(c) for c in ("block", "shard", "n")}
        for name, which in KINDS.items():
            rows = np.flatnonzero(kind == which)
            rows = rows[np.argsort(known[rows])]
            at = np.full(len(keys), len(x) - 1)
            if len(rows):
                place = rows[np.minimum(np.searchsorted(known[rows], keys), len(rows) - 1)]
                at = np.where(known[place] == keys, place, at)
            parts = []
            for a, b in zip(ends, ends[1:], strict=False):
                number, n = codes_of(pair[at[a:b]])
                one = np.empty(n, np.int64)
                one[number] = at[a:b]
                parts.append((n, packed(number.astype("<u4")), packed(x[one]), packed(y[one])))
            for i, (c, t) in enumerate(((f"{name}_n", pa.int32()), (name, pa.binary()), (f"{name}_x", pa.binary()), (f"{name}_y", pa.binary()))):
                out[c] = pa.array([part[i] for part in parts], t)
        return pa.table(out)

    sharded = model.withColumn("shard", F.shiftrightunsigned("key", 64 - bits))
    return wanted.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(run, FOUND)


def values_of(found: list[dict], name: str, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both values of each gram of a block, from what its shards found."""
    out = np.zeros(len(order)), np.zeros(len(order))
    start = 0
    for part in found:
        number = unpacked(part[name], part["n"], "<u4")
        for i, c in enumerate("xy"):
            out[i][order[start : start + part["n"]]] = unpacked(part[f"{name}_{c}"], part[f"{name}_n"], "<f8")[number]
        start += part["n"]
    return out


def scored(coded: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of a word (null without one) of every row."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        parts = sorted(found.to_pylist(), key=lambda part: part["shard"])
        for row in block.select(["docs", "symbols", "words"]).to_pylist():
            x, docs = sequences(**row, train=False)
            sizes = np.cumsum([0, *(len(x.table[n]) for n in range(1, ORDER + 1))])
            _, order = grams_of(x)
            count, _ = values_of(parts, "gram", order)
            total_of, left_of = values_of(parts, "context", order)
            p = values_of(parts, "even", order)[0][x.context[0]]
            p = np.where(p > 0, p, 1e-4)
            for n in range(1, ORDER + 1):
                context = x.context[n - 1] + (sizes[n - 2] if n > 1 else 0)
                total, left = total_of[context], left_of[context]
                p = np.where(total > 0, count[x.number[n] + sizes[n - 1]] / np.maximum(total, 1) + left * p, p)
            n_words = docs.column("n_words").to_numpy()
            logs = np.bincount(x.doc, np.log(p), docs.num_rows) + docs.column("spelled").to_numpy()
            perplexity = np.exp(np.minimum(-logs / (n_words + 1), math.log(1e300)))
            value = pc.if_else(pa.array(n_words == 0), pa.scalar(None, pa.float64()), pa.array(perplexity))
            out.append(pa.table([docs.column("doc_id"), docs.column("lang"), docs.column("n_chars"), value], ["doc_id", "lang", "n_chars", "perplexity"]))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64()), "perplexity": pa.array([], pa.float64())})

    keys = max(coded.count() * KEYS_PER_BLOCK, model.count())
    bits = max(1, math.ceil(math.log2(max(1, keys / KEYS_PER_SHARD))))
    found = found_grams(wanted_grams(coded, bits), model, bits)
    return coded.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "doc_id long, lang string, n_chars long, perplexity double")
