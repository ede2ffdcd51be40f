"""Operator 1: quality rules as a short-circuit cascade.

Counts every document carries (`BASE`) come first and settle the plain failures. The further rules are timed on a
sample and put in the order of rejections per second; each is then computed only for the documents that all rules
before it let pass. The order changes the work, never the verdict: a document is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.texts import Words, codes_of, forget_others, give_back, slices, sums, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Slice:
    """Some documents: their texts, words and base counts."""

    texts: pa.Array
    words: Words
    base: dict[str, np.ndarray]

    def take(self, rows: np.ndarray) -> Slice:
        texts = self.texts.take(pa.array(rows))
        w, counts = self.words, np.diff(self.words.starts)[rows]
        starts = np.concatenate(([0], np.cumsum(counts)))
        codes = w.codes[np.repeat(w.starts[:-1][rows] - starts[:-1], counts) + np.arange(starts[-1])]
        return Slice(texts, Words(starts, codes, w.unique), {k: v[rows] for k, v in self.base.items()})


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.count_substring_regex(texts, pattern), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words inside a window of three words that occurs at least twice in the text."""
    doc, codes, n = words.doc_of_word(), words.codes, len(words.codes)
    covered = np.zeros(n, bool)
    if n > 2:
        pairs, _ = codes_of(codes[:-1] * (len(words.unique) + 1) + codes[1:])
        triples, distinct = codes_of(pairs[:-1] * (len(words.unique) + 1) + codes[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        twice = inside[pd.Series(doc[inside] * distinct + triples[inside]).duplicated(keep=False).to_numpy()]
        for shift in range(3):
            covered[twice + shift] = True
    return sums(covered, words.starts)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), counts)
    lines = lists.flatten()
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    has_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    again = pd.Series(doc * (len(lines) + 1) + codes).duplicated().to_numpy() & has_word
    return np.bincount(doc[again], minlength=len(texts)).astype(np.int64)


def measured(texts: pa.Array) -> Slice:
    words = words_of(texts)
    length = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = matches(words.unique, SYMBOLS)
    base = {
        "n_words": np.diff(words.starts),
        "word_chars": sums(length[words.codes], words.starts),
        "n_symbols": sums(symbols[words.codes], words.starts),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(words),
    }
    return Slice(texts, words, base)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


@dataclass(frozen=True)
class Rule:
    """`rejects` gives for each document of a slice whether the rule rejects it."""

    name: str
    rejects: Callable[[Slice], np.ndarray]


def many_symbols(s: Slice) -> np.ndarray:
    return 10 * s.base["n_symbols"] > s.base["n_words"]


def odd_word_length(s: Slice) -> np.ndarray:
    return (s.base["word_chars"] < 3 * s.base["n_words"]) | (s.base["word_chars"] > 12 * s.base["n_words"])


def many_repeated_lines(s: Slice) -> np.ndarray:
    """At least three lines, and over three in ten of those with a word, repeat an earlier one."""
    lines = pc.split_pattern(pc.fill_null(s.texts, ""), "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    has_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines.flatten())), 0).to_numpy(zero_copy_only=False)
    repeats = s.base["n_dup_lines"]
    return (repeats >= 3) & (10 * repeats > 3 * sums(has_word, np.concatenate(([0], np.cumsum(counts)))))


def few_letters(s: Slice) -> np.ndarray:
    """Under eight in ten words hold a letter."""
    letters = pc.match_substring_regex(s.words.unique, r"\p{L}").to_numpy(zero_copy_only=False)
    return 10 * sums(letters[s.words.codes], s.words.starts) < 8 * s.base["n_words"]


def shouting(s: Slice) -> np.ndarray:
    """Over four in ten letters are capitals."""
    capitals, letters = matches(s.words.unique, r"\p{Lu}"), matches(s.words.unique, r"\p{L}")
    return 10 * sums(capitals[s.words.codes], s.words.starts) > 4 * sums(letters[s.words.codes], s.words.starts)


def exclaiming(s: Slice) -> np.ndarray:
    """Over one exclamation or question mark for every four words."""
    marks = matches(s.words.unique, "[!?]")
    return 4 * sums(marks[s.words.codes], s.words.starts) > s.base["n_words"]


RULES = (
    Rule("shouting", shouting),
    Rule("few_letters", few_letters),
    Rule("exclaiming", exclaiming),
    Rule("many_repeated_lines", many_repeated_lines),
    Rule("odd_word_length", odd_word_length),
    Rule("many_symbols", many_symbols),
)


def rejected(s: Slice, rules: Iterable[Rule]) -> np.ndarray:
    """Base failures and, for the rest, the rules in turn, each on what is left."""
    out = base_failed(s.base)
    for rule in rules:
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left] = rule.rejects(s.take(left))
    return out


def estimated(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) on a random sample of about `rows` documents, judged where they lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent, hits = 0, dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0)
        for batch in slices(batches):
            s = measured(batch.column("text"))
            s = s.take(np.flatnonzero(~base_failed(s.base)))
            seen += len(s.texts)
            for rule in rules:
                begun = time.perf_counter()
                hits[rule.name] += int(rule.rejects(s).sum())
                spent[rule.name] += time.perf_counter() - begun
        columns = [list(spent), list(spent.values()), list(hits.values()), [seen] * len(rules)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rule", "seconds", "hits", "seen"])

    sample = docs.select("text").sample(min(1.0, rows / max(docs.count(), 1)), seed=seed)
    out = sample.mapInArrow(run, "rule string, seconds double, hits long, seen long").groupBy("rule").agg(F.sum("seconds"), F.sum("hits"), F.sum("seen"))
    return [(r[0], r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in out.collect()]  # one row per rule


def ordered(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, best first; rules without an estimate stay in their order, last."""
    worth = {name: share / max(seconds, 1e-9) for name, seconds, share in estimates}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row.

    Null, empty and blank texts have no words and fail. Repeated rows are judged alike, each on its own; other columns
    are left out. An empty table gives an empty result.
    """
    plan = ordered(rules, estimated(docs, rules, sample_rows)) if len(rules) > 1 else list(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = measured(batch.column("text"))
            failed = base_failed(s.base)
            columns = [batch.column("doc_id"), *(pa.array(s.base[k]) for k in BASE), pa.array(failed), pa.array(~rejected(s, plan))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns, that no rule rejects."""
    plan = ordered(rules, estimated(docs, rules, sample_rows)) if len(rules) > 1 else list(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("quality")
        for batch in slices(batches):
            yield batch.filter(pa.array(~rejected(measured(batch.column("text")), plan)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
