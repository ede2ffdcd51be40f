"""Operator 10: near-duplicate groups by circulant MinHash and exact verification.

One hash moves the shingles to a ring of 2^64 places (the first permutation); a second, one-to-one mixing of the ring
is read at places shifted by k for signature coordinate k, so two permutations give all coordinates. Bands of
coordinates make buckets. Documents with equal shingle sets are one vertex throughout.

Inside a bucket not all pairs are compared. The member with the largest buckets overall, most likely the common original,
is compared with all others; the links found are turned into components, and only members of different components are
looked at further. In small buckets these are all compared. In large ones shingles are told apart by how many of the
documents at issue have them: two texts can only be linked when they share a rare shingle, which few other texts have, or
when the common shingles alone suffice. The first are found by a join on rare shingles; for the second the common
ones are counted, and a share of the members that grows eightfold per round until it is all of them meets the rest. At
the end each two members of a bucket are in one component, have been compared, or cannot be linked.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.components import components
from vacantia.llm.texts import codes_of, giving_back, hashes, mixed, slices, words_of
from vacantia.session import stage

ROWS_PER_BAND = 4
MISS = 1e-6
CACHED = 1 << 14
SMALL, RARE = 16, 8
PARTS = 16
PAIR_BYTES = 2 << 20
PAIR_ROWS = 1000
#: Ids of documents that share a bucket, sent to all tasks while they are this few; 2 million take some 100 MB there.
MAX_BROADCAST_IDS = 2_000_000
NAME = ["set_1", "set_2", "n_shingles"]


def bands_needed(similarity: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold shares no bucket with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def shingles(texts: pa.Array, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, one text after the other, and where those of each text start.

    Shingles are `size` words with A-Z lower-cased; a text with fewer words is one shingle, one without words has none.
    """
    words = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    of_word, doc, counts = mixed(hashes(words.unique) + np.uint64(salt))[words.codes], words.doc_of_word(), np.diff(words.starts)
    n = len(of_word)
    value = np.zeros(n, np.uint64)
    lengths = np.minimum(counts, size)
    for i in range(size):
        part = np.zeros(n, np.uint64)
        part[: max(n - i, 0)] = of_word[i:]
        part[lengths[doc] <= i] = np.uint64(i + 1)
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + part)
    place = np.arange(n) - words.starts[:-1][doc]
    starts_one = place <= np.maximum(counts - size, 0)[doc]
    value, doc = value[starts_one], doc[starts_one]
    codes, distinct = codes_of(value)
    first = ~pd.Series(doc * max(distinct, 1) + codes).duplicated().to_numpy()
    value, doc = value[first], doc[first]
    return value, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def signatures(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash coordinates of every non-empty set, one row each."""
    begins = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(begins), coordinates), np.uint64)
    row = 0
    while row < len(begins):  # a few thousand values at a time stay in the processor's cache
        end = max(row + 1, int(np.searchsorted(begins, begins[row] + CACHED, side="right")) - 1)
        part = values[begins[row] : begins[end] if end < len(begins) else len(values)]
        local, shifted, high = begins[row:end] - begins[row], np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint64(k * 0x9E3779B97F4A7C15 % 2**64), out=shifted)
            np.bitwise_xor(shifted, np.right_shift(shifted, np.uint64(32), out=high), out=shifted)
            np.multiply(shifted, np.uint64(0xD6E8FEB86659FD93), out=shifted)
            np.bitwise_xor(shifted, np.right_shift(shifted, np.uint64(32), out=high), out=shifted)
            out[row:end, k] = np.minimum.reduceat(shifted, local)
        row = end
    return out


def summaries(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """id, n_shingles, two sums naming the set, and the bucket of each band, of every row."""
    bands = bands_needed(similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, starts = shingles(batch.column("text"), size)
            n = len(starts) - 1
            full = np.diff(starts) > 0
            names = np.zeros((2, n), np.int64)
            for row, salt in enumerate((0x1D8E4E27C47D124F, 0x27220A95FE1DBF1F)):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(salt)), dtype=np.uint64)))
                names[row] = (total[starts[1:]] - total[starts[:-1]]).view(np.int64)
            signature = signatures(values, starts, bands * ROWS_PER_BAND)
            buckets = np.zeros((len(signature), bands), np.uint64)
            for band in range(bands):
                key = np.full(len(signature), band + 1, np.uint64)
                for k in range(band * ROWS_PER_BAND, (band + 1) * ROWS_PER_BAND):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
                buckets[:, band] = key
            at = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(buckets.reshape(-1).view(np.int64)))
            columns = [batch.column("id"), pa.array(np.diff(starts)), pa.array(names[0]), pa.array(names[1]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_1", "set_2", "buckets"])

    return docs.mapInArrow(giving_back(run), "id long, n_shingles long, set_1 long, set_2 long, buckets array<long>")


def verified(pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) of those rows (a, b, text_a, text_b) whose full shingle sets are similar enough."""
    percent = round(100 * similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in slices(batches, "text_a", PAIR_BYTES) for part in slices([b], "text_b", PAIR_BYTES)):
            (x, x_starts), (y, y_starts) = (shingles(batch.column(c), size) for c in ("text_a", "text_b"))
            n = batch.num_rows
            codes, distinct = codes_of(np.concatenate((x, y)))
            pair = np.concatenate([np.repeat(np.arange(n), np.diff(s)) for s in (x_starts, y_starts)])
            both = pd.Series(pair * max(distinct, 1) + codes).duplicated().to_numpy()
            common = np.bincount(pair[both], minlength=n)
            union = np.diff(x_starts) + np.diff(y_starts) - common
            good = pa.array((union > 0) & (100 * common >= percent * union))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(giving_back(run), "a long, b long").distinct()


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(id, shingle) of every distinct shingle of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, starts = shingles(batch.column("text"), size)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(values.view(np.int64))], ["id", "shingle"])

    return texts.select("id", "text").mapInArrow(giving_back(run), "id long, shingle long")


def uniform(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / (1 << 40)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, growth: int = 8) -> DataFrame:
    """Groups of near duplicates; see `_near_duplicates`. All work with texts is done here, in small Arrow batches."""
    with arrow_rows(docs.sparkSession, PAIR_ROWS):
        return _near_duplicates(docs, size, similarity, growth)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs run inside: Arrow batches of at most `rows` rows, as two texts a row make default batches large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _near_duplicates(docs: DataFrame, size: int, similarity: float, growth: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id) of every row.

    Texts are linked when the Jaccard similarity of their sets of `size`-word shingles is `similarity` or more (compared
    as whole percents). Null, empty and blank texts have an empty set and are linked with nothing. Rows of one doc_id are
    one document: they are in one component. A null doc_id is linked with nothing, its component is null and it is kept.
    Other columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    facts = stage(summaries(rows, size, similarity), "minhash")
    named = facts.where("n_shingles > 0 AND id IS NOT NULL")
    sets = stage(named.groupBy(*NAME).agg(F.min("id").alias("id"), F.min_by("buckets", "id").alias("buckets")), "minhash-sets")
    placed = sets.select("id", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = stage(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "minhash-shared")
    members = stage(placed.join(shared, "bucket"), "minhash-members")
    weights = stage(members.groupBy("id").agg(F.sum("n").alias("weight")), "minhash-weights")
    # Texts of the members alone, for verification. While their ids are sent to all tasks, the texts of the others stay where they are.
    ids = weights.select("id")
    texts = stage(rows.join(F.broadcast(ids) if weights.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi"), "minhash-texts")

    def compared(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        first = ends.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return verified(first.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"), size, similarity)

    percent = round(100 * similarity)

    def can_link(*counts: str) -> Column:
        """Whether two texts can be linked that share, of each counted part of their shingles, what the smaller has at most."""
        most = sum((F.least(c, f"other_{c}") for c in counts), F.lit(0))
        return (100 * most >= percent * (F.col("n_shingles") + F.col("other_shingles") - most)) & (F.col("x") != F.col("y"))

    may_link = can_link("common")
    centres = (
        members.join(weights, "id")
        .groupBy("bucket")
        .agg(F.max_by(F.struct("id", "n_shingles"), F.struct("weight", -F.col("id"))).alias("c"))
        .select("bucket", F.col("c.id").alias("y"), F.col("c.n_shingles").alias("other_shingles"), F.col("c.n_shingles").alias("other_common"))
    )
    links = stage(compared(members.withColumn("common", F.col("n_shingles")).withColumnRenamed("id", "x").join(centres, "bucket").where(may_link)), "minhash-links")
    # Rows of one id with different sets stand for one document.
    several = named.groupBy("id").agg(F.min("set_1").alias("low"), F.max("set_1").alias("high")).where("low < high").select("id")
    same_id = named.join(several, "id", "left_semi").join(sets.select(*NAME, F.col("id").alias("b")), NAME)
    links = links.union(same_id.where("id <> b").select(F.col("id").alias("a"), "b"))
    found = components(links)

    def with_components(rows: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def still_open(rows: DataFrame) -> DataFrame:
        """Rows, with their components, of the buckets whose members are of several components."""
        state = with_components(rows)
        several = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        return stage(state.join(several, "bucket", "left_semi"), "minhash-open")

    def tested(pairs: DataFrame) -> None:
        nonlocal links, found
        more = stage(compared(pairs), "minhash-links")
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)

    def other(rows: DataFrame, on: str) -> DataFrame:
        return rows.select(on, F.col("id").alias("y"), F.col("component").alias("other"), F.col("n_shingles").alias("other_shingles"), F.col("common").alias("other_common"))

    apart = F.col("component") != F.col("other")
    state = still_open(members.where("n > 2").withColumn("common", F.col("n_shingles")))
    small = state.where(F.col("n") <= SMALL)
    if not small.isEmpty():
        tested(small.withColumnRenamed("id", "x").join(other(small, "bucket"), "bucket").where(may_link & apart & (F.col("x") < F.col("y"))))
    large = state.where(F.col("n") > SMALL).drop("common", "component")
    if not large.isEmpty():
        rows = stage(shingle_rows(texts.join(large.select("id").distinct(), "id", "left_semi"), size), "minhash-shingles")
        found_in = stage(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "minhash-df")
        parts = [f"part_{k}" for k in range(PARTS)]
        part = F.pmod("shingle", F.lit(PARTS))
        common = rows.join(found_in.where(F.col("df") > RARE).select("shingle"), "shingle")
        common = common.groupBy("id").agg(*(F.count(F.when(part == k, 1)).alias(c) for k, c in enumerate(parts)))
        large = stage(large.join(common, "id", "left").fillna(0, parts), "minhash-large")
        # Two texts that share a rare shingle are compared, whatever else they share.
        facts_of = with_components(large.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shingles").alias("common")))
        # One edit makes several shingles that the same texts have. Such texts, RARE at most, meet once.
        having = rows.join(found_in.where(F.col("df") <= RARE).select("shingle"), "shingle").groupBy("shingle").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        having = having.where(F.size("ids") > 1).select("ids").distinct().select(F.xxhash64("ids").alias("having"), F.explode("ids").alias("id"))
        rare = stage(having.distinct().join(facts_of, "id"), "minhash-rare")
        tested(rare.withColumnRenamed("id", "x").join(other(rare, "having"), "having").where(may_link & apart & (F.col("x") < F.col("y"))))
        # Others share common shingles only, counted apart by their hash. Those with too few of them are linked to none.
        large = large.where(100 * sum((F.col(c) for c in parts), F.lit(0)) >= percent * F.col("n_shingles"))
        low = 1
        while True:
            state = still_open(large.where(F.col("n") > low))
            if state.isEmpty():
                break
            share, high = uniform("bucket", "id"), low * growth
            pivots = state.where((share < F.lit(high) / F.col("n")) & ((share >= F.lit(low) / F.col("n")) | F.lit(low == 1)))
            pivots = pivots.select("bucket", F.col("id").alias("y"), F.col("component").alias("other"), F.col("n_shingles").alias("other_shingles"), *(F.col(c).alias(f"other_{c}") for c in parts))
            tested(state.withColumnRenamed("id", "x").join(pivots, "bucket").where(can_link(*parts) & apart))
            low = high
    named_sets = stage(sets.join(found, "id", "left").select(*NAME, F.coalesce("component", "id").alias("component")), "minhash-named")
    out = facts.select("id", *NAME).join(named_sets, NAME, "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
