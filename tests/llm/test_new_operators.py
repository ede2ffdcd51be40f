"""Token alignment, SimHash groups and periodic runs against plain versions, on a table with every odd case."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vacantia.llm import alignment, periods, simhash
from vacantia.llm.queries import with_planted_periods
from vacantia.llm.texts import words_of

from . import plain

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def rows():
    return plain.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The documents with further columns whose names the operators use themselves."""
    extra = ", block long, pair string, n long, id long, key string, choice int, fingerprint string, runs string, a string, count string"
    data = [(*r, 1, "p", 2, None, "k", 3, "f", "r", "a", "c") for r in rows]
    return spark.createDataFrame(data, plain.SCHEMA + extra).repartition(3)


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- alignment ----


class Libraries:
    """Tokens of whole texts from the libraries themselves, without cutting them."""

    def __init__(self):
        self.first, self.second = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
        self.first.encode_special_tokens = True
        self.bytes_a = alignment.ByteLevel(alignment.file_bytes(BYTES)).bytes
        self.bytes_b = [bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode() for i in range(self.second.vocab_size())]

    def groups(self, text):
        if not text:
            return []
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return []
        ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def alignment_rows(rows, libraries):
    all_groups = [libraries.groups(t) for _, t, *_ in rows]
    links = [[(a, b) for x, y in g for a in x for b in y] for g in all_groups]
    count = Counter(p for pairs in links for p in set(pairs))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    return Counter(
        (r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(p), sum(count[x] == highest[x[0]] for x in p), sum(count[x] for x in p), written(g))
        for r, g, p in zip(rows, all_groups, links, strict=True)
    )


COUNTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_alignment(docs, rows, libraries):
    want = alignment_rows(rows, libraries)
    assert got(alignment.align(docs, BYTES, PIECES), *COUNTS, "groups") == want
    hashed = Counter({(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else ""): n for r, n in want.items()})
    assert got(alignment.align(docs, BYTES, PIECES, groups="sha256"), *COUNTS, "groups_sha256") == hashed
    with pytest.raises(ValueError, match="groups"):
        alignment.align(docs, BYTES, PIECES, groups="md5")


def test_a_chunk_is_encoded_and_resolved_once(libraries, monkeypatch):
    encoders = alignment.Encoder(alignment.ByteLevel(alignment.file_bytes(BYTES))), alignment.Encoder(alignment.Pieces(alignment.file_bytes(PIECES)))
    encoded, resolved = [], []
    for encoder in encoders:
        monkeypatch.setattr(encoder.tokenizer, "encode", lambda strings, own=encoder.tokenizer.encode: encoded.extend(strings) or own(strings))
    monkeypatch.setattr(alignment, "diagonals", lambda a, b, own=alignment.diagonals: resolved.append(len(a)) or own(a, b))
    texts = ["one twofold unresolvable " * 50 + "one", "", "twofold two  spaces", "unresolvable\x00 one"]
    for chosen in (texts, texts[::-1], texts[:1]):
        x = alignment.aligned(pa.array(chosen), *encoders)
        assert alignment.group_texts(x).to_pylist() == [written(libraries.groups(t)) for t in chosen]
    assert len(encoded) == 2 * len(set(encoded)) and max(resolved) < 100
    # Beyond the bounds of what a worker keeps, chunks are encoded anew, with the same result.
    monkeypatch.setattr(alignment, "HELD_BYTES", 0)
    x = alignment.aligned(pa.array(["a chunk not seen before", *texts]), *encoders)
    assert not encoders[0].table.places and alignment.group_texts(x).to_pylist()[1:] == [written(libraries.groups(t)) for t in texts]


def test_alignment_of_an_empty_table(docs):
    assert alignment.align(docs.where("false"), BYTES, PIECES).count() == 0
    assert got(alignment.align(docs.where("doc_id IS NULL AND text = ''").unionByName(docs.where("text = ''")), BYTES, PIECES), *COUNTS[1:], "groups") == Counter({(0, 0, 0, 0, 0, 0, ""): 1})


def test_odd_texts_are_cut_without_changing_tokens(libraries):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "日本", "　", "\u0085", "\xa0", "'s", "1", "!", "<s>", "<|endoftext|>", "́", "\x00", "\U0001f600", "\x1c", "\t", "▁", "don't", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ["=-" * 500, "ab" * 700, " ", "x "]
    x = alignment.aligned(pa.array(texts), *alignment.encoders(alignment.file_bytes(BYTES), alignment.file_bytes(PIECES)))
    assert alignment.group_texts(x).to_pylist() == [written(libraries.groups(t)) for t in texts]
    assert (x.starts_a[1:] > x.starts_a[:-1]).sum() > 300
    large = alignment.LARGE_GROUP
    try:
        whole = alignment.pair_lists(x)
        alignment.LARGE_GROUP = 1  # every group of several tokens is kept by pairs of distinct ids
        assert all((a == b).all() for i, (a, b) in enumerate(zip(whole, alignment.pair_lists(x), strict=True)) if i in (0, 1, 4))
    finally:
        alignment.LARGE_GROUP = large


def test_diagonals_meet_at_common_ends():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 300)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*a} - set(rng.sample(a, min(3, len(a) - 1))) | {n})
        common = sorted(set(a) & set(b))
        group_a, group_b = alignment.diagonals(np.array(a), np.array(b))
        assert [a[i - 1] for i in group_a] == common and [b[i - 1] for i in group_b] == common
    assert [v.tolist() for v in alignment.diagonals(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


# ---- SimHash ----


def fingerprint(text, size):
    w = plain.words((text or "").translate(plain.ASCII_LOWER))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(vertices, linked):
    """The smallest vertex each one reaches."""
    label, rest = {}, sorted(vertices)
    for v in rest:
        if v not in label:
            front = [v]
            while front:
                x = front.pop()
                if x not in label:
                    label[x] = v
                    front += [y for y in rest if y not in label and linked(x, y)]
    return label


@pytest.mark.parametrize("shingles", [5, 1 << 12])
def test_fingerprints(rows, shingles, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    texts = [r[1] for r in rows]
    for size in (1, 4):
        assert simhash.fingerprints_of(pa.array(texts), size).tolist() == [fingerprint(t, size) for t in texts]
    assert simhash.fingerprints_of(pa.array(texts)[3:9], 4).tolist() == [fingerprint(t, 4) for t in texts[3:9]]
    assert simhash.fingerprints_of(pa.array([], pa.string()), 4).tolist() == []


@pytest.mark.parametrize("small", [0, 4, 64])
def test_links_of_lists(small, monkeypatch):
    rng = np.random.default_rng(1)
    for pairs in (3, 50, 1 << 20):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        starts = np.concatenate(([0], np.cumsum(rng.integers(1, 30, 8))))
        members = np.concatenate([rng.choice(1 << 14, n, replace=False) for n in np.diff(starts)]).astype(np.uint64)
        want = set()
        for a, b in zip(starts, starts[1:], strict=False):
            label = smallest(range(a, b), lambda x, y: bin(int(members[x]) ^ int(members[y])).count("1") <= 4)
            want |= {(members[r], members[x]) for x, r in label.items() if x != r}
        assert set(zip(*simhash.list_links(starts, members, small), strict=True)) == want


def simhash_rows(pairs, size):
    """(doc_id, fingerprint, component_id); a doc_id is one vertex with all its fingerprints."""
    marks = [(i, fingerprint(t, size)) for i, t in pairs]
    of = defaultdict(set)
    for i, f in marks:
        of[i].add(f)
    label = smallest([i for i in of if i is not None], lambda a, b: any(bin(x ^ y).count("1") <= 4 for x in of[a] for y in of[b]))
    return Counter((i, f - (1 << 64) * (f >> 63), label.get(i)) for i, f in marks)


def test_simhash_groups(docs, rows):
    assert got(simhash.near_duplicates(docs, 4), "doc_id", "fingerprint", "component_id") == simhash_rows([r[:2] for r in rows], 4)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_a_long_list_is_split_and_gives_the_same_groups(spark, monkeypatch):
    rng = random.Random(5)
    near_copies = [plain.prose(rng, 40).replace("\n", " ").split(" ")] * 90
    texts = [" ".join([*w[:-1], f"end{rng.randrange(60)}"]) for w in near_copies] + [plain.prose(rng, 3) for _ in range(60)] + ["", " "]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = simhash_rows(pairs, 2)
    assert max(Counter(c for _, _, c in want).values()) > 20
    for long in (simhash.LONG, 3):
        monkeypatch.setattr(simhash, "LONG", long)
        assert got(simhash.near_duplicates(df, 2), "doc_id", "fingerprint", "component_id") == want


def test_every_pair_within_four_bits_shares_a_list(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    pairs = [(base, base ^ sum(1 << b for b in rng.sample(range(64), 4))) for _ in range(300)]
    signed = [[x - (1 << 64) * (x >> 63) for x in p] for p in pairs]
    df = spark.createDataFrame([(x,) for p in signed for x in p], "fingerprint long").distinct()
    lists = defaultdict(set)
    for choice, key, f in simhash.by_bytes(df).collect():
        lists[choice, key].add(f)
    assert all(any({a, b} <= members for members in lists.values()) for a, b in signed)
    half = simhash.by_half_bytes(simhash.by_bytes(df).where("choice = 0"))
    assert half.select("fingerprint").distinct().count() == df.count() and half.groupBy("choice", "key", "further", "part", "fingerprint").count().where("count > 1").isEmpty()


# ---- periodic runs ----


def brute_runs(w, least=6, powers=4):
    found = {}
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng, n, kinds):
    w = []
    while len(w) < n:
        part = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 9))]
        w += (part * rng.randint(1, 8))[: rng.randint(1, 70)] if rng.random() < 0.5 else part
    return w[:n]


def test_runs_of_repetitive_words():
    rng = random.Random(1)
    for _ in range(400):
        w = repetitive(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 5, 50]))
        numbers = [hash(x) % 1000 for x in w]
        for powers in (4, 5):
            found = periods.runs_of(np.array([*numbers, 5000]), len(w), powers)
            assert list(zip(*(v.tolist() for v in found), strict=True)) == brute_runs(numbers, 4, powers)


def test_convolution_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    for b in (1, 2, 8, 64):
        blocks, following = rng.integers(0, 1 << 29, (5, b)), rng.integers(0, 1 << 29, (5, 2 * b))
        for r in range(5):
            shift = rng.integers(0, b)
            following[r, shift : shift + b] = blocks[r]
            if r == 0:
                following[r, shift] += periods.PRIMES[0][0]  # zero modulo the first prime only
        want = [[(following[r, s : s + b] == blocks[r]).all() for s in range(b)] for r in range(5)]
        assert (periods.zero_differences(blocks, following) == want).all()
    with pytest.raises(ValueError, match="primes"):
        monkeypatch.setattr(periods, "PRIMES", periods.PRIMES[:1])
        periods.zero_differences(np.full((1, 2), 1 << 40), np.full((1, 4), 1 << 40))


def test_primes_and_roots():
    for p, g in periods.PRIMES:
        assert p < 1 << 32 and (p - 1) % (1 << 27) == 0 and all(p % d for d in range(2, 66000)) and pow(g, (p - 1) // 2, p) == p - 1


def test_a_text_of_one_word_and_long_periods_end_soon():
    same = np.append(np.zeros(300_000, np.int64), 7)
    assert [v.tolist() for v in periods.runs_of(same, 300_000)] == [[0], [300_000], [1]]
    long = np.append(np.tile(np.random.default_rng(1).permutation(50_000), 5), 70_000)
    assert [v.tolist() for v in periods.runs_of(long, 250_000)] == [[0], [250_000], [50_000]]


def test_periodic_runs(spark, docs, rows):
    rng = random.Random(4)
    more = [(100 + i, " ".join(repetitive(rng, rng.randint(0, 300), 3)), None, None, None) for i in range(40)]
    df = docs.select("doc_id", "text", "runs", "block").union(spark.createDataFrame([(*r[:2], "r", 1) for r in more], "doc_id long, text string, runs string, block long"))
    for least in (6, 12):
        want = Counter()
        for doc_id, text, *_ in [*rows, *more]:
            w = plain.words(text)
            runs = brute_runs(w, least) if len(w) < 2000 or len(set(w)) > 1 else [(0, len(w), 1)]
            want[doc_id, len(w), tuple(runs), collapsed(w, runs)] += 1
        out = periods.periodic_runs(df, least=least).collect()
        assert Counter((r[0], r[1], tuple(tuple(x) for x in r[2]), r[3]) for r in out) == want
    assert periods.periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periods.periodic_runs(df, powers=3)


def test_planted_periods_keep_other_texts():
    words = words_of(pa.array(["a b c d e f g h i j"] * 60 + [""]))
    codes = with_planted_periods([*range(60), None], words)
    changed = (codes != words.codes).reshape(60, 10).any(axis=1)
    assert 0 < changed.sum() < 20
