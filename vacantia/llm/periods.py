"""Operator 13: periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least `powers` (four or more) periods long, that no neighbouring
word extends. All texts of a slice are one sequence of word numbers, with a number of its own behind each text, so no
run crosses texts. At the scale B, a power of two, the sequence is cut into blocks of B words, and an exact integer
convolution gives, for each block and every distance from B to 2B - 1, the sum of squared differences between the block
and the words that far behind it: zero where the block occurs again. A run of period q, B <= q < 2B, repeats itself over
3q words or more and so holds two neighbouring blocks that both occur again at distance q; such distances are the seeds,
and each is extended to both sides as far as words q apart are equal.

Two exact rules keep the work in proportion to the input. A block is left out when a word of it does not come back
within 2B words, or when the block and all its distances lie inside a run of smaller period found before. A seed is left
out when it lies inside such a run: two runs that overlap by the sum of their periods are one, so its distance is a
multiple of that run's period. What remains are squares with a root of their own, of which few start at any one block.

The convolution is a number-theoretic transform over primes whose product exceeds the largest possible sum, so zero
means equal. Tasks work on one slice of texts at a time; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.texts import Words, slices, words_of

#: Primes below 2^32 of the form k * 2^27 + 1 or with more factors of two, each with a primitive root.
PRIMES = ((2013265921, 31), (2281701377, 3), (3221225473, 5), (3489660929, 3))
TEXT_BYTES = 2 << 20
CELLS = 1 << 17
NEVER = np.iinfo(np.int64).max


@lru_cache(maxsize=256)
def twiddles(size: int, prime: int, base: int) -> np.ndarray:
    """The first half of the powers of an element of order `size`."""
    step = pow(base, (prime - 1) // size, prime)
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate((out, out * np.uint64(pow(step, len(out), prime)) % np.uint64(prime)))
    return out


def transform(rows: np.ndarray, prime: int, root: int, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in natural order."""
    p = np.uint64(prime)
    base = pow(root, prime - 2, prime) if inverse else root
    m, size = rows.shape
    out, left = rows.reshape(m, size, 1), size
    while left > 1:
        half = left // 2
        low, high = out[:, :half], out[:, half:]
        turned = (low + (p - high)) % p * twiddles(left, prime, base)[None, :, None] % p
        out = np.stack(((low + high) % p, turned), axis=2).reshape(m, half, -1)
        left = half
    out = out.reshape(m, size)
    return out * np.uint64(pow(size, prime - 2, prime)) % p if inverse else out


def zero_differences(blocks: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Whether the sum over i of (block[i] - following[s + i])^2 is zero, for each row and shift s below the block's length.

    `following` has rows of twice the length. Values are not negative.
    """
    rows, b = blocks.shape
    most = max(int(blocks.max(initial=0)), int(following.max(initial=0)))
    zero, at, bound = np.ones((rows, b), bool), np.arange(rows), b * most * most
    for prime, root in PRIMES:
        p = np.uint64(prime)
        x, y = blocks[at].astype(np.uint64) % p, following[at].astype(np.uint64) % p
        turned = np.zeros_like(y)
        turned[:, (-np.arange(b)) % (2 * b)] = x
        product = transform(turned, prime, root) * transform(y, prime, root) % p
        common = transform(product, prime, root, inverse=True)[:, :b]
        squares = np.concatenate((np.zeros((len(at), 1), np.uint64), np.cumsum(y * y % p, axis=1, dtype=np.uint64)), axis=1)
        total = (x * x % p).sum(axis=1, dtype=np.uint64)[:, None] + squares[:, b : 2 * b] - squares[:, :b]
        zero[at] &= total % p == common * np.uint64(2) % p
        bound //= prime
        at = at[zero[at].any(axis=1)]
        if not bound or not len(at):
            return zero
    raise ValueError("the numbers are too large for the primes")


def next_distance(codes: np.ndarray) -> np.ndarray:
    """How far behind each place its number comes again; NEVER for the last."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), NEVER)
    same = codes[order[:-1]] == codes[order[1:]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def agreeing(codes: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many places from `at` on, in the direction `step`, have the same number as those `distance` behind them."""
    out, active, width = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    last = len(codes) - 1
    while len(active):
        rest = []
        for part in np.array_split(active, max(1, len(active) * width // CELLS)):
            place = (at[part] + step * out[part])[:, None] + step * np.arange(width)
            far = place + distance[part][:, None]
            same = (place >= 0) & (far <= last) & (codes[np.clip(place, 0, last)] == codes[np.clip(far, 0, last)])
            whole = same.all(axis=1)
            out[part] += np.where(whole, width, np.argmin(same, axis=1))
            rest.append(part[whole])
        active, width = np.concatenate(rest), min(2 * width, CELLS)
    return out


def runs_of(codes: np.ndarray, longest: int, powers: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run at least `powers` periods long, by start and period.

    `codes` numbers the words, with a number used once behind each text; no text has more than `longest` words.
    """
    n = len(codes)
    distances = next_distance(codes)
    reach = np.zeros(n + 1, np.int64)
    found = [np.empty((3, 0), np.int64)]
    b = 1
    while 4 * b <= longest:
        count = n // b
        wanted = distances[: count * b].reshape(count, b).max(axis=1) < 2 * b
        begin = np.arange(count) * b
        wanted &= begin + 4 * b > reach[begin]
        beside = np.concatenate((wanted[1:], [False])) | np.concatenate(([False], wanted[:-1]))
        blocks = np.flatnonzero(wanted & beside)
        zero = np.zeros((len(blocks), b), bool)
        rows = max(1, CELLS // (2 * b))
        for row in range(0, len(blocks), rows):
            starts = blocks[row : row + rows, None] * b
            places = starts + np.arange(b, 3 * b)
            # Behind the end there is a number no block has.
            following = np.where(places < n, codes[np.minimum(places, n - 1)], codes.max(initial=0) + 1)
            zero[row : row + rows] = zero_differences(codes[starts + np.arange(b)], following)
        pair = np.flatnonzero(np.diff(blocks) == 1)
        first, shift = np.nonzero(zero[pair] & zero[pair + 1])
        block, distance = blocks[pair[first]], shift + b
        seed = block * b
        fresh = seed + 2 * b + distance > reach[seed]
        block, distance = block[fresh], distance[fresh]
        order = np.lexsort((block, distance))
        block, distance = block[order], distance[order]
        joins = (np.diff(block) == 1) & (np.diff(distance) == 0)
        head, tail = np.concatenate(([True], ~joins))[: len(block)], np.concatenate((~joins, [True]))[: len(block)]
        low, high, distance = block[head] * b, (block[tail] + 2) * b, distance[head]
        if len(low):
            low = low - agreeing(codes, low - 1, distance, -1)
            high = high + agreeing(codes, high, distance, 1)
            runs = np.unique(np.stack((low, high - low + distance, distance)), axis=1)
            runs = runs[:, runs[1] >= 4 * runs[2]]
            found.append(runs[:, runs[1] >= powers * runs[2]])
            np.maximum.at(reach, runs[0], runs[0] + runs[1])
            reach = np.maximum.accumulate(reach)
        b *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    column: str = "text",
    least: int = 6,
    powers: int = 4,
    rewrite: Callable[[list, Words], np.ndarray] | None = None,
) -> DataFrame:
    """Per row its id, `n_words`, `runs` (array of start, length, period, by start then period) and `collapsed`.

    Runs are at least `least` words and `powers` periods long; `powers` under four is refused. `collapsed` are the words
    without those any run holds after its first period, joined by one space. `rewrite` may give other word numbers for the
    texts before. Null, empty and blank texts have no words, no runs and an empty `collapsed`; repeated rows and rows
    with a null id are worked on alike; an empty table gives an empty result; other columns are left out. A text of any
    length is one sequence, whose runs are found at any period.
    """
    if powers < 4:
        raise ValueError("runs are at least four periods long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, TEXT_BYTES):
            words = words_of(batch.column(column))
            codes = words.codes if rewrite is None else rewrite(batch.column(id_column).to_pylist(), words)
            texts, counts = batch.num_rows, np.diff(words.starts)
            doc = words.doc_of_word()
            # One number more behind each text.
            sequence = np.empty(len(codes) + texts, np.int64)
            begins = words.starts + np.arange(texts + 1)
            place = np.arange(len(codes)) + doc
            sequence[place] = codes
            sequence[begins[1:] - 1] = len(words.unique) + np.arange(texts)
            start, length, period = runs_of(sequence, int(counts.max(initial=0)), powers)
            good = length >= least
            start, length, period = start[good], length[good], period[good]
            covered = np.zeros(len(sequence) + 1, np.int64)
            np.add.at(covered, start + period, 1)
            np.add.at(covered, start + length, -1)
            kept = np.cumsum(covered)[place] == 0
            kept_starts = np.concatenate(([0], np.cumsum(np.bincount(doc[kept], minlength=texts))))
            strings = words.unique.take(pa.array(codes[kept]))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_starts.astype(np.int32)), strings), " ")
            of = np.searchsorted(begins, start, side="right") - 1
            run_starts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=texts)))).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            columns = [batch.column(id_column), pa.array(counts), pa.ListArray.from_arrays(pa.array(run_starts), structs), collapsed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_column), F.col(column))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
