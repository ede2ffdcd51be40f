"""Operator 6: benchmark decontamination by pigeonhole and Myers' bit-parallel distance.

A passage that differs from a test item in at most k characters keeps at least one of k + 1 pieces of the item whole. So
all pieces of the items are looked for at once by an automaton, and around each hit the item's edit distance to the best
substring is computed, one character of text per step for the whole item. Items of few words must occur word for word.
Items are a table in blocks of bounded size, which tasks read from the shared folder; documents are read once per block and
never move.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.archives import file_system
from vacantia.llm.texts import slices
from vacantia.session import stage, stage_folder

ERROR_RATE = 0.08
# Items of fewer words have no edits to spare.
EDITED_WORDS = 5
BLOCK_CHARS = 1 << 20

Item = tuple[int, str]


def plain(texts: pa.Array) -> pa.Array:
    """Texts in lower case with their words joined by one space."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower)), " ")


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 pieces that make up the text, with their offsets."""
    bounds = [i * len(text) // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def is_short(text: str, edited_words: int) -> bool:
    return text.count(" ") + 1 < edited_words


def budget(text: str, rate: float, edited_words: int = EDITED_WORDS) -> int:
    return 0 if is_short(text, edited_words) else int(len(text) * rate)


def is_apart(text: str, begin: int, end: int) -> bool:
    """Whether a part of a text begins and ends with words."""
    return (begin == 0 or text[begin - 1] == " ") and (end == len(text) or text[end] == " ")


def best_distance(item: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of `item` to any substring of `text`, and where the first such substring ends."""
    size = len(item)
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    mask, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = mask, 0, size, size, 0
    for i, c in enumerate(text):
        match = equal.get(c, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (mask & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        vertical = match | minus
        plus, minus = (down | ~(vertical | up)) & mask, up & vertical & mask
        if score < best:
            best, end = score, i + 1
    return best, end


class Finder:
    def __init__(self, items: list[Item], rate: float, edited_words: int = EDITED_WORDS):
        import ahocorasick

        self.items, self.errors = items, [budget(text, rate, edited_words) for _, text in items]
        self.short = [is_short(text, edited_words) for _, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.errors[n]):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, int]:
        """Distance by item number, for items that occur in `text` within their budget."""
        windows: dict[int, list[list[int]]] = {}
        if not self.items or not text:
            return {}
        for last, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                begin, errors = last + 1 - length - offset, self.errors[n]
                if self.short[n] and not is_apart(text, begin, last + 1):
                    continue
                low, high = max(0, begin - errors), begin + len(self.items[n][1]) + errors
                mine = windows.setdefault(n, [])
                if mine and low <= mine[-1][1] and low >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], high)
                else:
                    mine.append([low, high])
        out = {}
        for n, mine in windows.items():
            distance = min(best_distance(self.items[n][1], text[a:b])[0] for a, b in mine)
            if distance <= self.errors[n]:
                out[n] = distance
        return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> tuple[str, int]:
    """Folder of the distinct items that have a word, in blocks by a hash of their text, and the number of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column("text"))
            some = pc.greater(pc.binary_length(text), 0)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").filter(some), text.filter(some)], ["item_id", "text"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, text string")
    items = stage(rows.distinct(), "items")
    blocks = max(1, math.ceil((items.agg(F.sum(F.char_length("text"))).first()[0] or 0) / block_chars))
    folder = f"{stage_folder(benchmark.sparkSession).rstrip('/')}/vacantia/item-blocks-{uuid.uuid4().hex}"
    items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def read_block(folder: str, number: int) -> list[Item]:
    system, path = file_system(folder)
    files = system.get_file_info(fs.FileSelector(f"{path}/block={number}", allow_not_found=True))
    tables = [pq.ParquetFile(system.open_input_file(f.path)).read(["item_id", "text"]) for f in files if f.base_name.endswith(".parquet")]
    return sorted(((r["item_id"], r["text"]) for t in tables for r in t.to_pylist()), key=lambda r: (r[1], r[0] is None, r[0]))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, edited_words: int = EDITED_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): every document with every benchmark item that occurs in it.

    An item occurs when its edit distance, in characters, to some substring of the text is at most `rate` times its length.
    Case and the kind of white space do not count. Items of fewer than `edited_words` words occur only word for word; null and
    empty ones are not looked for; null and empty texts have no items. Ids may be null. Equal items are looked for once, and each
    repeated document row gives its own rows. Other columns are left out; an empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder, blocks = item_blocks(benchmark, block_chars)
    out = None
    for number in range(blocks):

        def run(batches: Iterable[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            block = read_block(folder, number)
            finder = Finder(block, rate, edited_words)
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], block[n][0], distance) for i, text in enumerate(plain(batch.column("text")).to_pylist()) for n, distance in finder.found(text).items()]
                columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, edited_words: int = EDITED_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no benchmark item occurs. See `contaminated`."""
    folder, blocks = item_blocks(benchmark, block_chars)
    for number in range(blocks):

        def run(batches: Iterable[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            finder = Finder(read_block(folder, number), rate, edited_words)
            for batch in slices(batches):
                yield batch.filter(pa.array([not finder.found(text) for text in plain(batch.column("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
