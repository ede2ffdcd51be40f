"""The word model of operator 3 against its definition, and what a model of characters cannot see."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import perplexity, word_grams
from vacantia.session import stage_folder

B, E, U = "<begin>", "<end>", "<unknown>"


def brute(train: list[list[str]], order: int):
    """Interpolated modified Kneser-Ney over lists of words from its definition, the vocabulary cut at MIN_COUNT."""
    counts = Counter(w for t in train for w in t)
    known = {w for w, c in counts.items() if c >= word_grams.MIN_COUNT}
    padded = lambda t: (B,) * (order - 1) + tuple(w if w in known else U for w in t) + (E,)
    levels = {order: Counter(s[i : i + order] for s in map(padded, train) for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(gram: tuple) -> float:
        n = len(gram)
        if not n:
            return 1 / (len(levels[1]) + 1)
        _, n1, n2, n3, n4 = (sum(c == i for c in levels[n].values()) for i in range(5))
        d = [0.5] * 3
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = [i - (i + 1) * y * b / a if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        same = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total, left = sum(same.values()), sum(d[min(c, 3) - 1] for c in same.values())
        c = levels[n][gram]
        return (c - d[min(c, 3) - 1] if c else 0) / total + left / total * p(gram[1:])

    return padded, p


def chain(rng: random.Random, n: int) -> list[str]:
    """Words of which each allows three successors."""
    at, out = rng.randrange(60), []
    for _ in range(n):
        out.append(f"w{at}")
        at = (7 * at + rng.randrange(3)) % 60
    return out


def test_word_perplexity_follows_the_definition(spark):
    rng = random.Random(4)
    train = [chain(rng, 12) + [f"once{i}"] * (i % 3 == 0) for i in range(8)]
    asked = [chain(rng, 9), ["w1", "never", "w2", "once0"], train[3]]
    data = [(i, " ".join(t), "en", True) for i, t in enumerate(train)] + [(100 + i, " \n".join(t), "en", False) for i, t in enumerate(asked)]
    data += [(200, " ", "en", False), (201, None, "en", False)]
    blocks = word_grams.blocks_of(spark.createDataFrame(data, "doc_id long, text string, lang string, train boolean").repartition(3))
    uses = word_grams.word_uses(blocks)
    known = {w for w, c in Counter(w for t in train for w in t).items() if c >= 2}
    symbols = uses.select("symbol", "word").distinct().where(~uses.word.isin(sorted(known)))
    unknown = uses.select("block", "symbol").join(symbols.selectExpr("symbol", "-7D AS spelled"), "symbol")
    coded = word_grams.coded_blocks(blocks, unknown)
    out = {r.doc_id: r for r in word_grams.scored(coded, word_grams.model_of(word_grams.gram_counts(coded))).collect()}
    padded, p = brute(train, word_grams.ORDER)
    for i, t in enumerate(asked):
        s = padded(t)
        logs = [np.log(p(s[j - word_grams.ORDER + 1 : j + 1])) for j in range(word_grams.ORDER - 1, len(s))]
        spelled = -7 * sum(w not in known for w in t)
        assert out[100 + i].perplexity == pytest.approx(np.exp(-(sum(logs) + spelled) / len(logs)), rel=1e-6)
    assert out[200].perplexity is None and out[201].perplexity is None and out[200].n_chars == 1 and len(out) == len(data)


def test_words_in_any_order_do_not_pass(spark):
    rng = random.Random(9)
    good = [[f"{w}longer" for w in chain(rng, 120)] for _ in range(150)]
    mixed = [rng.sample(t, len(t)) for t in good[100:]]
    data = [(i, " ".join(t), "en") for i, t in enumerate(good)] + [(1000 + i, " ".join(t), "en") for i, t in enumerate(mixed)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in perplexity.quality_by_perplexity(spark.createDataFrame(data, "doc_id long, text string, lang string"), labels).collect()}
    assert sum(out[i] for i in range(100, 150)) >= 47 and not any(out[1000 + i] for i in range(len(mixed)))


def test_keys_are_those_of_spark(spark):
    rng = np.random.default_rng(3)
    grams = np.concatenate((rng.integers(0, 2**64, (50, word_grams.ORDER), np.uint64), np.zeros((1, word_grams.ORDER), np.uint64)))
    df = spark.createDataFrame([tuple(g) for g in grams.view(np.int64).tolist()], word_grams.GRAMS)
    want = [r[0] for r in df.coalesce(1).select(word_grams.key_of([df[n] for n in word_grams.NAMES])).collect()]
    assert word_grams.keys_of(grams).view(np.int64).tolist() == want


def test_parts_and_shards_change_nothing_and_only_scores_stay(spark, monkeypatch):
    rng = random.Random(6)
    data = [(i, " ".join(chain(rng, 60) + [f"once{i}"] * (i % 3 == 0)), ("en", "de", None)[i % 3]) for i in range(90)] + [(1, None, "en"), (None, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    of = lambda: sorted(map(tuple, perplexity.quality_by_perplexity(docs, labels).collect()), key=str)
    want = of()
    folder = os.path.join(stage_folder(spark).removeprefix("file:"), "vacantia")
    before = set(os.listdir(folder))
    monkeypatch.setattr(perplexity, "BLOCKS_PER_ROUND", 1)
    monkeypatch.setattr(word_grams, "KEYS_PER_SHARD", 1 << 15)
    got = of()
    assert len(got) == len(data) and got == want
    left = set(os.listdir(folder)) - before
    assert len(left) == perplexity.ROUNDS and all(name.startswith("scores-") for name in left)
