"""Operator 8: line deduplication within one edit of a word, by a deletion-neighbourhood join.

Two lines are within one edit when one word was added, dropped or replaced. Then both have the same line with one word
deleted, or one is the other with a word deleted. Each candidate line emits itself and all its deletions as
hashed keys with the place of the deletion. Lines under one key and place are all within one edit of each other, and a
line is within one edit of all under its own key, so the earliest of each group is found by aggregation alone and no pairs
are emitted. The one witness found for a line is compared with it word by word.

Candidates are lines that share their first or last half with another line: one edit leaves one half whole.
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
from vacantia.llm.texts import Words, giving_back, hashes, mixed, words_of
from vacantia.session import stage

MIN_WORDS = 1
MIN_WORDS_EDITED = 8


def placed(of_word: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of words at their places, from -1 on."""
    of_place = mixed(np.arange(-1, int(place.max(initial=0)) + 1).astype(np.uint64) + np.uint64(salt))
    return mixed(of_word + of_place[place + 1])


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


@dataclass
class Lines:
    """Lines of the documents of a batch. `counted` lines have enough words; `id_1`, `id_2` name their content."""

    doc_id: np.ndarray
    per_doc: np.ndarray
    text: pa.Array
    doc: np.ndarray
    number: np.ndarray
    words: Words
    counted: np.ndarray
    id_1: np.ndarray
    id_2: np.ndarray
    halves: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.starts)


def lines_of(batch: pa.RecordBatch, with_halves: bool = True) -> Lines:
    doc_id = pc.fill_null(batch.column("doc_id"), -(2**63)).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    text = lists.flatten()
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    number = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(per_doc)))[:-1][doc]
    words = words_of(text)
    line, starts, n = words.doc_of_word(), words.starts, np.diff(words.starts)
    of_word = mixed(hashes(words.unique))[words.codes]
    place = np.arange(len(line)) - starts[:-1][line]
    forward, other = running(placed(of_word, place, 1)), running(placed(of_word, place, 2))
    ids = [sums[starts[1:]] - sums[starts[:-1]] for sums in (forward, other)]
    # First and last halves, in the two lengths that a partner of one word more or less may have.
    halves = np.empty((len(n), 4), np.uint64)
    backward = running(placed(of_word, n[line] - 1 - place, 3)) if with_halves else forward
    for i, half in enumerate((n // 2, np.maximum(n - 1, 0) // 2)):
        halves[:, 2 * i] = mixed(forward[starts[:-1] + half] - forward[starts[:-1]] + half.astype(np.uint64) * np.uint64(2))
        halves[:, 2 * i + 1] = mixed(backward[starts[1:]] - backward[starts[1:] - half] + half.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return Lines(doc_id, per_doc, text, doc, number, words, n >= MIN_WORDS, ids[0].view(np.int64), ids[1].view(np.int64), halves)


def earliest(x: Lines) -> np.ndarray:
    """Of each content the first counted line of the batch, by document and number."""
    order = np.lexsort((x.number, x.doc_id[x.doc]))
    order = order[x.counted[order]]
    again = pd.DataFrame({"a": x.id_1[order], "b": x.id_2[order]}).duplicated().to_numpy()
    return order[~again]


def keys_of_lines(x: Lines, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines `at` and the line of each: halves of those that may be edited, else the whole line."""
    edited = x.n_words[at] >= MIN_WORDS_EDITED
    halves = x.halves[at[edited]].copy()
    same = halves[:, 0] == halves[:, 2]
    key = np.concatenate((halves[:, :2].reshape(-1), halves[~same, 2:].reshape(-1), mixed(x.id_1[at[~edited]].view(np.uint64))))
    return key, np.concatenate((np.repeat(at[edited], 2), np.repeat(at[edited][~same], 2), at[~edited]))


def line_keys(batch: pa.RecordBatch) -> np.ndarray:
    x = lines_of(batch)
    return keys_of_lines(x, earliest(x))[0]


CANDIDATE = "block long, id_1 long, id_2 long, doc_id long, number int, n_words int, halves array<long>, line string"


def candidate_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, payload, marks in zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "marks")), strict=True):
            x = lines_of(B.unpack(payload))
            key, line = keys_of_lines(x, earliest(x))
            at = np.unique(line[B.marks_of_keys(key, B.marks_of(marks)) > 0])
            n = x.n_words[at]
            halves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 4), pa.array(x.halves[at].reshape(-1).view(np.int64)))
            columns = [np.full(len(at), block), x.id_1[at], x.id_2[at], x.doc_id[x.doc[at]], x.number[at].astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), halves, x.text.take(pa.array(at))], [f.split()[0] for f in CANDIDATE.split(", ")])


def variant_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, id_1, id_2, doc_id, number): the line itself at place -1, then without its word at each place.

    Where only the first half is shared with other lines, words of it are not deleted, as the edit lies behind it; likewise
    for the last half.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            words = words_of(batch.column("line"))
            line, starts = words.doc_of_word(), words.starts
            of_word = mixed(hashes(words.unique))[words.codes]
            place = np.arange(len(line)) - starts[:-1][line]
            here, moved = running(placed(of_word, place, 1)), running(placed(of_word, place - 1, 1))
            without = here[:-1] - here[starts[:-1]][line] + moved[starts[1:]][line] - moved[1:]
            whole_line = here[starts[1:]] - here[starts[:-1]]
            n, counts = len(whole_line), np.diff(starts)
            half = np.maximum(counts - 1, 0) // 2
            front, back = (batch.column(c).to_numpy(zero_copy_only=False)[line] for c in ("front", "back"))
            at = np.flatnonzero((front & (place >= half[line])) | (back & (place < (counts - half)[line])))
            row = np.concatenate((np.arange(n), line[at]))
            columns = [np.concatenate((whole_line, without[at])).view(np.int64), np.concatenate((np.full(n, -1), place[at])).astype(np.int32)]
            names = ["id_1", "id_2", "doc_id", "number"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(c).take(pa.array(row)) for c in names)], ["key", "place", *names])


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether the Levenshtein distance of two word lists is at most one."""
    shorter, longer = sorted((len(a), len(b)))
    if longer - shorter > 1:
        return False
    same = 0
    while same < shorter and a[same] == b[same]:
        same += 1
    behind = 0
    while behind < shorter - same and a[-1 - behind] == b[-1 - behind]:
        behind += 1
    return same + behind >= longer - 1


def confirmed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ([line.split(" ") for line in pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(batch.column(c))), " ").to_pylist()] for c in ("line", "other_line"))
        good = pa.array([within_one_edit(a, b) for a, b in zip(*texts, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("id_1", "id_2")], ["id_1", "id_2"])


def cut_rows(schema: pa.Schema | None):
    """Rows of the blocks without their repeated lines; `schema` None gives counts and text, else all columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, found in zip(batch.column("payload").to_pylist(), batch.column("found"), strict=True):
                rows = B.unpack(payload)
                x = lines_of(rows, with_halves=False)
                at = np.flatnonzero(x.counted)
                mine = pd.DataFrame({"a": x.id_1[at], "b": x.id_2[at], "doc": x.doc_id[x.doc[at]], "number": x.number[at], "at": at})
                first = earliest(x)
                known = pd.DataFrame({"a": x.id_1[first], "b": x.id_2[first], "first_doc": x.doc_id[x.doc[first]], "first_number": x.number[first], "beaten": False})
                if found.is_valid:
                    told = {k: found.values.field(f).to_numpy(zero_copy_only=False) for k, f in zip(known.columns, ("id_1", "id_2", "first_doc", "first_number", "beaten"), strict=True)}
                    known = pd.concat([pd.DataFrame(told), known]).drop_duplicates(["a", "b"])
                mine = mine.merge(known, on=["a", "b"])
                gone = mine.beaten.to_numpy(bool) | (mine.first_doc < mine.doc).to_numpy() | ((mine.first_doc == mine.doc) & (mine.first_number < mine.number)).to_numpy()
                kept = np.ones(len(x.doc), bool)
                kept[mine["at"].to_numpy()[gone]] = False
                left = np.bincount(x.doc[kept], minlength=len(x.per_doc))
                ends = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), x.text.filter(pa.array(kept))), "\n")
                if schema is None:
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(x.per_doc), pa.array(x.per_doc - left), text], ["doc_id", "n_lines", "n_removed", "text"])
                    continue
                text = pc.if_else(pa.array(left < x.per_doc), text, rows.column("text"))
                columns = {n: rows.column(n) for n in rows.schema.names} | {"text": text}
                if "n_chars" in columns:
                    length = pc.utf8_length(text).cast(columns["n_chars"].type)
                    columns["n_chars"] = pc.if_else(pa.array(left < x.per_doc), length, columns["n_chars"])
                out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(text, ""))), 0).to_numpy(zero_copy_only=False)
                yield out.filter(pa.array(~(blank & (left < x.per_doc))))

    return giving_back(run)


def judged(blocks: DataFrame) -> DataFrame:
    """`payload` of each block, and for the lines that other lines may repeat: their first place, and whether an earlier line beats them."""
    rows = stage(B.marked(blocks, other_blocks=False, heavy=2**62).mapInArrow(giving_back(candidate_rows), CANDIDATE), "lines")
    first = F.min(F.struct("doc_id", "number")).alias("first")
    contents = rows.groupBy("id_1", "id_2").agg(first, F.min("n_words").alias("n_words"), F.min("line").alias("line"), F.min("halves").alias("halves"))
    contents = stage(contents.select("id_1", "id_2", "first.*", "n_words", "line", "halves"), "contents")
    edited = contents.where(F.col("n_words") >= MIN_WORDS_EDITED)
    halves = edited.select("id_1", "id_2", F.posexplode("halves").alias("which", "half"))
    several = halves.groupBy("half").agg(F.min("id_1").alias("low"), F.max("id_1").alias("high")).where("low < high").select("half")
    shared = halves.join(several, "half", "left_semi").groupBy("id_1", "id_2")
    shared = shared.agg(F.max(F.col("which") % 2 == 0).alias("front"), F.max(F.col("which") % 2 == 1).alias("back"))
    close = stage(edited.drop("halves").join(shared, ["id_1", "id_2"]), "close")
    variants = close.select("id_1", "id_2", "doc_id", "number", "line", "front", "back")
    variants = stage(variants.mapInArrow(giving_back(variant_rows), "key long, place int, id_1 long, id_2 long, doc_id long, number int"), "variants")
    met = variants.groupBy("key").agg(F.min("id_1").alias("low"), F.max("id_1").alias("high")).where("low < high").select("key")
    variants = stage(variants.join(met, "key", "left_semi"), "met")
    best = F.min(F.struct("doc_id", "number", "id_1", "id_2")).alias("best")
    whole, cut = variants.where("place < 0"), variants.where("place >= 0")
    groups = [
        (cut, ["key", "place"], cut.groupBy("key", "place").agg(best, F.count("*").alias("n")).where("n > 1").drop("n")),
        (cut, ["key"], whole.groupBy("key").agg(best)),
        (whole, ["key"], cut.groupBy("key").agg(best)),
    ]
    witness = None
    for side, on, group in groups:
        part = side.join(group, on).where("best.doc_id < doc_id OR best.doc_id = doc_id AND best.number < number").select("id_1", "id_2", "best")
        witness = part if witness is None else witness.union(part)
    witness = witness.groupBy("id_1", "id_2").agg(F.min("best").alias("best")).select("id_1", "id_2", F.col("best.id_1").alias("o_1"), F.col("best.id_2").alias("o_2"))
    other = close.select(F.col("id_1").alias("o_1"), F.col("id_2").alias("o_2"), F.col("line").alias("other_line"))
    pairs = witness.join(other, ["o_1", "o_2"]).join(close.select("id_1", "id_2", "line"), ["id_1", "id_2"])
    beaten = pairs.select("id_1", "id_2", "line", "other_line").mapInArrow(giving_back(confirmed_rows), "id_1 long, id_2 long").withColumn("beaten", F.lit(True))
    verdicts = contents.join(beaten, ["id_1", "id_2"], "left").select("id_1", "id_2", F.col("doc_id").alias("first_doc"), F.col("number").alias("first_number"), F.coalesce("beaten", F.lit(False)).alias("beaten"))
    verdicts = stage(verdicts, "verdicts")
    lists = rows.select("block", "id_1", "id_2").join(verdicts, ["id_1", "id_2"])
    lists = lists.groupBy("block").agg(F.collect_list(F.struct("id_1", "id_2", "first_doc", "first_number", "beaten")).alias("found"))
    return blocks.select("block", "payload").join(lists, "block", "left").select("payload", "found")


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without its repeated lines, of every row.

    Lines are cut at line feeds. A line of at least MIN_WORDS words (one: a word at all) goes when the same words stand in an earlier line
    (smaller document, or same document before), and one of at least MIN_WORDS_EDITED words also when an earlier such line
    is within one edit of a word. All lines are judged on the input, not on what is left. A null or empty text is one blank
    line and stays. A null id comes before all others. Rows of one id are one document; lines at equal places do not
    precede each other, so of repeated rows all stay. Other columns are left out; an empty table gives an empty result.
    """
    blocks = B.packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), line_keys, "line-blocks")
    return judged(blocks).mapInArrow(cut_rows(None), "doc_id long, n_lines long, n_removed long, text string")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the same columns; repeated lines are cut from `text` and `n_chars`, if there, follows.

    Rows that lose all their words are dropped. See `line_digest`.
    """
    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return judged(B.packed(whole, line_keys, "line-blocks")).mapInArrow(cut_rows(whole.schema), whole.schema)
