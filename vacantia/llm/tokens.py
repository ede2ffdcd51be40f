"""Operator 2: token ids in Parquet list columns, laid out for selective reads.

Files hold rows in ascending document order, one file per range of ids. Ids of documents and lengths are delta-encoded,
tokens dictionary-encoded; row groups and pages are small and have page indexes, so a range of documents or the lengths
alone are read without the rest. Each row knows its start within its file; the few totals of the files give the start
in the whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.bpe import ids_array, vocabulary_text
from vacantia.llm.texts import WordTable, encoded, slices, worker_state
from vacantia.session import stage_folder

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}


#: Words that the tokenizer keeps whole: Latin letters, none of which it turns into several.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


def library(text: str) -> WordTable:
    """A table of words encoded by the tokenizer of a file, built once per Python worker."""
    state = worker_state("tokens")
    if state.get("text") == text:
        return state["table"]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def run(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [PLAIN.fullmatch(w) is not None for w in words]
        together, alone = list(compress(words, plain)), [w for w, p in zip(words, plain, strict=True) if not p]
        # Plain words go together, a thousand to a text; each ends with the one token that ends a word.
        joined = np.concatenate([np.empty(0, np.uint32), *run([" ".join(together[i : i + 1000]) for i in range(0, len(together), 1000)])])
        last = np.flatnonzero(ends[joined])
        single = run(alone)
        counts = np.empty(len(words), np.int64)
        counts[plain] = np.diff(last, prepend=-1)
        counts[np.invert(plain)] = [len(x) for x in single]
        out = np.empty(counts.sum(), np.uint32)
        mine = np.repeat(np.array(plain, bool), counts)
        out[mine], out[~mine] = joined, np.concatenate([np.empty(0, np.uint32), *single])
        return out, counts

    state.update(text=text, table=WordTable(encode_new))
    return state["table"]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, files: int | None = None) -> str:
    """Write doc_id, file, start_in_file, n_tokens, tokens; each document ends with `end_id`. Returns the folder.

    A null text is empty: its only token is the end. Null ids come first, equal ids are ordered by their text; rows
    equal in both are written side by side. Other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_text(tokenizer_path))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library(shared.value)
        file, total = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, starts = encoded(batch.column("text"), table)
            n = len(starts) - 1
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(n + 1)
            columns = [batch.column("doc_id"), pa.array(np.full(n, file, np.int32)), pa.array(total + starts[:-1]), pa.array(np.diff(starts)), ids_array(ids, starts)]
            total += int(starts[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "start_in_file", "n_tokens", "tokens"])

    # The texts are dealt out, not the tokens: finding the ranges then reads ids only, and encodes nothing twice.
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(run, "doc_id long, file int, start_in_file long, n_tokens long, tokens array<int>")
    rows.write.options(**LAYOUT).parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The written rows with `start`: the number of ids of all documents before."""
    rows = spark.read.schema("doc_id long, file int, start_in_file long, n_tokens long, tokens array<int>").parquet(folder)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    # One row per file, so at most as many as there were partitions.
    return rows.join(F.broadcast(totals), "file").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the tokens as little-endian 32-bit numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))) * 4
            raw, bounds = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()), starts.astype(int).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return f"{stage_folder(spark).rstrip('/')}/vacantia/tokens-{uuid.uuid4().hex}"
