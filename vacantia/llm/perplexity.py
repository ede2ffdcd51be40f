"""Operator 3: quality classifier by perplexity under an interpolated modified Kneser-Ney model of words.

Grams of words are counted and looked up in `word_grams`. What a word outside the vocabulary of its language adds is the
probability of its spelling under a model of characters, below, trained on the words that trusted text has only once. That model,
ORDER characters at a time, is joined level by level in Spark, cut by hash into shards of bounded size in the shared folder,
and merged by every slice of distinct unknown words with one shard after another.

A document is kept when its perplexity is at most a quantile, per language, of that of trusted documents held out of
training, times a margin.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm import word_grams
from vacantia.llm.texts import codes_of, mixed, slices, worker_state
from vacantia.llm.word_grams import discounts
from vacantia.session import Stages, stage, without_old_shuffles

ORDER = 5
BEGIN, END = "\x02", "\x03"
QUANTILE, MARGIN = 0.99, 1.1
FOLDS = 10
SHARD_ROWS = 1 << 20
CACHE_SHARDS = 6
MAX_BROADCAST_ROWS = 2_000_000
SCORE_BYTES = 2 << 20
STEPS = 1000
#: Blocks are scored in so many parts, one after the other, so that the shuffles of all do not lie on the disk at once.
ROUNDS, BLOCKS_PER_ROUND = 4, 8


def grams(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Grams of a slice: (number of each in text order, its text, characters of the distinct ones, their languages, names)."""
    coded = pc.fill_null(langs, "").dictionary_encode()
    padded = BEGIN * (ORDER - 1)
    strings = [padded + t.replace("\0", " ") + END for t in pc.fill_null(texts, "").to_pylist()]
    characters = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    ids, size = codes_of(characters)
    alphabet = np.zeros(size, np.uint32)
    alphabet[ids] = characters
    # The first ORDER - 1 characters of each text are padding.
    inside = np.ones(len(characters), bool)
    for i in range(ORDER - 1):
        inside[np.cumsum(lengths) - lengths + i] = False
    last = np.flatnonzero(inside)
    doc = np.repeat(np.arange(len(strings), dtype=np.int32), lengths - ORDER + 1)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    bound = len(coded.dictionary)
    for back in range(ORDER - 1, -1, -1):
        if bound * size >= 2**63:
            key, bound = codes_of(key)
        key, bound = key * size + ids[last - back], bound * size
    number, distinct = codes_of(key)
    first = np.empty(distinct, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    at = last[first]
    shape = np.stack([alphabet[ids[at - back]] for back in range(ORDER - 1, -1, -1)], axis=1) if distinct else np.empty((0, ORDER), np.uint32)
    return number, doc, shape, coded.indices.to_numpy(zero_copy_only=False)[doc[first]], coded.dictionary


def strings_of(shape: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(shape.astype("<u4")).view(f"<U{shape.shape[1]}").reshape(-1).tolist() if len(shape) else [], pa.string())


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, c) over all rows, summed per slice before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SCORE_BYTES):
            number, _, shape, lang, names = grams(batch.column("text"), batch.column("lang"))
            counts = np.bincount(number, minlength=len(shape))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), strings_of(shape), pa.array(counts)], ["lang", "gram", "c"])

    rows = trusted.select("text", "lang").mapInArrow(run, "lang string, gram string, c long")
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model_rows(counts: DataFrame, write: word_grams.Write = stage) -> DataFrame:
    """(lang, gram, size, prob, value): log probability of a gram's last character, or log back-off weight of a context.

    `size` is the gram's length; the weight of the empty context and the even probability of an unseen character have
    the empty gram.
    """
    by_size = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        shorter = by_size[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("c"))
        by_size[size] = write(shorter, "grams")
    lower = by_size[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    out = lower.select("lang", "gram", F.lit(0).alias("size"), F.lit(True).alias("prob"), F.log("p").alias("value"))
    for size in range(1, ORDER + 1):
        d = discounts(by_size[size])
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = by_size[size].withColumn("context", F.substring("gram", 1, size - 1)).withColumn("taken", taken)
        contexts = write(seen.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("taken") / F.sum("c")).alias("left")), "contexts")
        shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
        level = seen.withColumn("suffix", F.substring("gram", 2, size - 1)).join(contexts, ["lang", "context"]).join(shorter, ["lang", "suffix"])
        p = (F.col("c") - F.col("taken")) / F.col("total") + F.col("left") * F.col("shorter")
        lower = write(level.select("lang", "gram", p.alias("p")), "levels")
        out = out.union(lower.select("lang", "gram", F.lit(size), F.lit(True), F.log("p")))
        out = out.union(contexts.select("lang", F.col("context").alias("gram"), F.lit(size - 1), F.lit(False), F.log("left")))
    return out


def name_hashes(names: pa.Array) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(names) else np.empty(0, np.uint64)


def keys(shape: np.ndarray, lang_hash: np.ndarray, prob: bool) -> np.ndarray:
    """Hashes of grams (rows of characters) of one size, apart for probabilities and weights."""
    key = mixed(lang_hash + np.uint64(2 * shape.shape[1] + prob))
    for i in range(shape.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + shape[:, i].astype(np.uint64))
    return key


def write_model(rows: DataFrame, folder: str, write: word_grams.Write = stage) -> tuple[str, int]:
    """The model as sorted shards by hash, at about SHARD_ROWS rows each; gives folder and number of shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prob = batch.column("size").to_numpy(), batch.column("prob").to_numpy(zero_copy_only=False)
            lang_hash = name_hashes(batch.column("lang"))
            out = np.empty(len(size), np.uint64)
            for n in np.unique(size):
                for kind in (True, False):
                    at = np.flatnonzero((size == n) & (prob == kind))
                    strings = batch.column("gram").take(pa.array(at)).to_pylist()
                    shape = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").reshape(len(at), int(n))
                    out[at] = keys(shape, lang_hash[at], kind)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column("value")], ["key", "value"])

    rows = write(rows, "model")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    hashed = rows.mapInArrow(run, "key long, value double").withColumn("shard", F.pmod("key", F.lit(shards)))
    hashed.repartition(shards, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)
    return folder, shards


def shard(folder: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of one shard; a worker remembers a few."""
    state = worker_state("perplexity")
    if (folder, number) not in state:
        if len(state) >= CACHE_SHARDS:
            state.pop(next(iter(state)))
        system, path = fs.FileSystem.from_uri(folder if re.match(r"[a-z][a-z0-9+.-]*:", folder) else f"file://{folder}")
        files = system.get_file_info(fs.FileSelector(f"{path}/shard={number}", allow_not_found=True))
        tables = [pq.read_table(f.path, filesystem=system, columns=["key", "value"]) for f in files if f.base_name.endswith(".parquet")]
        key = np.concatenate([np.empty(0, np.int64), *(t.column("key").to_numpy() for t in tables)])
        value = np.concatenate([np.empty(0), *(t.column("value").to_numpy() for t in tables)])
        order = np.argsort(key)
        state[folder, number] = key[order], value[order].astype(np.float32)
    return state[folder, number]


def looked_up(wanted: np.ndarray, folder: str, shards: int) -> np.ndarray:
    """Values of keys, NaN where the model has none; one shard after another."""
    wanted = wanted.view(np.int64)
    out = np.full(len(wanted), np.nan)
    where = np.mod(wanted, shards)
    for number in range(shards):
        mine = np.flatnonzero(where == number)
        key, value = shard(folder, number)
        if len(mine) and len(key):
            at = np.minimum(np.searchsorted(key, wanted[mine]), len(key) - 1)
            out[mine] = np.where(key[at] == wanted[mine], value[at], np.nan)
    return out


def log_probabilities(shape: np.ndarray, lang_hash: np.ndarray, folder: str, shards: int) -> np.ndarray:
    """Of the last character of each gram: that of its longest known ending, times the weights of the contexts before."""
    parts = []
    for size in range(ORDER, -1, -1):
        parts.append(keys(shape[:, ORDER - size :], lang_hash, True))
        if size:
            parts.append(keys(shape[:, ORDER - size : -1], lang_hash, False))
    values = looked_up(np.concatenate(parts), folder, shards).reshape(len(parts), -1)
    out, weight, open_ = np.full(len(shape), math.log(1e-4)), np.zeros(len(shape)), np.ones(len(shape), bool)
    for i in range(0, len(parts), 2):
        known = open_ & ~np.isnan(values[i])
        out[known] = weight[known] + values[i][known]
        open_ &= ~known
        if i + 1 < len(parts):
            weight += np.nan_to_num(values[i + 1])
    return out


def scored(docs: DataFrame, folder: str, shards: int) -> DataFrame:
    """doc_id, lang, n_chars and perplexity (null without a word) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SCORE_BYTES):
            number, doc, shape, lang, names = grams(batch.column("text"), batch.column("lang"))
            logs = log_probabilities(shape, name_hashes(names)[lang], folder, shards)[number]
            total, n = np.bincount(doc, logs, batch.num_rows), np.bincount(doc, minlength=batch.num_rows)
            blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(batch.column("text"), ""))), 0)
            value = pc.if_else(blank, pa.scalar(None, pa.float64()), pa.array(np.exp(-total / np.maximum(n, 1))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(n - 1), value], ["doc_id", "lang", "n_chars", "perplexity"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, n_chars long, perplexity double")


def unknown_words(uses: DataFrame, write: word_grams.Write = stage) -> DataFrame:
    """(block, symbol, spelled) of the words outside the vocabulary, with the log probability of their spelling."""
    words = uses.groupBy("symbol", "lang", "word").agg(F.sum("c").alias("c"))
    rare = write(words.where(F.col("c") < word_grams.MIN_COUNT), "rare-words").withColumnRenamed("word", "text")
    with Stages(uses.sparkSession) as passing:
        counts = passing(gram_counts(rare.where("c > 0")), "grams")
        folder, shards = write_model(model_rows(counts, passing), f"{passing.folder}/shards", passing)
        spelled = scored(rare.withColumnRenamed("symbol", "doc_id"), folder, shards)
        spelled = write(spelled.select(F.col("doc_id").alias("symbol"), (-(F.col("n_chars") + 1) * F.log("perplexity")).alias("spelled")), "spelled")
    return uses.select("block", "symbol").join(spelled, "symbol").select("block", "symbol", "spelled")


def with_training_mark(rows: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """All rows with `train`: labelled good and not held out."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    few = good.count() <= MAX_BROADCAST_ROWS
    marked = rows.join(F.broadcast(good) if few else good, "doc_id", "left")
    return marked.select("doc_id", "text", "lang", (F.col("good").isNotNull() & training).alias("train"))


def joined_with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is labelled good; the ids are sent to all tasks while they are few, else both are shuffled."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = good.count() <= MAX_BROADCAST_ROWS
    return docs.join(F.broadcast(good) if few else good, "doc_id", "left_semi")


def thresholds(held_out: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, threshold): exact quantile of log perplexity in steps of 1/STEPS, plus the margin."""
    steps = held_out.where("perplexity IS NOT NULL").groupBy("lang", F.ceil(F.log("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    so_far, whole = Window.partitionBy("lang").orderBy("step"), Window.partitionBy("lang")
    steps = steps.withColumn("below", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(whole))
    reached = steps.where(F.col("below") >= F.lit(quantile) * F.col("total")).groupBy("lang").agg(F.min("step").alias("step"))
    return reached.select("lang", (F.exp(F.col("step") / STEPS) * margin).alias("threshold"))


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every row.

    Every tenth trusted document, by a hash of its id, is held out for the thresholds. A null language is a language of
    its own, called ''. A language without held-out documents has no threshold, and its documents are kept. Null, empty
    and blank texts have no perplexity and are not kept. Ids may be null; repeated rows are scored alike. Other columns
    are left out; empty tables give an empty result, and without labels all documents with a word are kept.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    spark = docs.sparkSession
    # Tables and shuffles go as soon as the next table is written, so that they do not lie on the disk side by side.
    with without_old_shuffles(spark), Stages(spark) as lasting:
        with Stages(spark) as passing:
            blocks = word_grams.blocks_of(with_training_mark(rows, labels, fold > 0), passing)
            coded = word_grams.coded_blocks(blocks, unknown_words(word_grams.word_uses(blocks, passing), passing), lasting)
        with Stages(spark) as passing:
            model = word_grams.model_of(word_grams.gram_counts(coded, passing), lasting, passing)
        rounds = max(1, min(ROUNDS, coded.count() // BLOCKS_PER_ROUND))
        of_round = F.pmod(F.xxhash64("block"), F.lit(rounds))
        scores = reduce(DataFrame.union, [stage(word_grams.scored(coded.where(of_round == r), model), "scores") for r in range(rounds)])
    limits = thresholds(joined_with_labels(scores, labels).where(fold == 0), quantile, margin)
    out = scores.join(limits, "lang", "left")
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
