"""Operators over documents against plain versions, on a table with every odd case."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from vacantia.llm import bpe, contamination, lines, minhash, perplexity, quality, repeats, texts, tokens
from vacantia.llm.components import components

from . import plain

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return plain.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The documents with further columns whose names the operators use themselves."""
    extra = ", block long, key string, kept string, id long, ids string, n_words string, component string, bucket string"
    data = [(*r, 1, "k", "kept?", None, "i", None, "c", "b") for r in rows]
    return spark.createDataFrame(data, plain.SCHEMA + extra).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_words_are_cut_at_ascii_white_space_only():
    data = ["", None, "  a b\x1c\tc\x0b\x0cd\r\n", "\x1ca\x85b　c", " ", "x"]
    w = texts.words_of(pa.array(data))
    split = [[w.unique[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:], strict=False)]
    assert split == [plain.words(t) for t in data]


def test_slices_keep_rows_and_bound_their_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "x" * 50, "", "de"] * 7})
    parts = list(texts.slices([batch, batch.slice(0, 0)], limit=20))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 20 for p in parts)


# ---- rules ----


def test_quality(docs, rows):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got(quality.quality(docs), *columns) == Counter((i, *plain.quality(t)) for i, t in pairs(rows))


def test_order_of_rules_changes_no_verdict_and_saves_work(docs):
    estimates = [("shouting", 1.0, 0.1), ("many_symbols", 0.01, 0.5)]
    assert [r.name for r in quality.ordered(quality.RULES, estimates)][:2] == ["many_symbols", "shouting"]
    s = quality.measured(pa.array([t for _, t in pairs(plain.documents())]))
    forward, backward = quality.rejected(s, quality.RULES), quality.rejected(s, quality.RULES[::-1])
    assert (forward == backward).all()
    seen = []
    rules = [quality.Rule("all", lambda x: np.ones(len(x.texts), bool)), quality.Rule("late", lambda x: seen.append(1) or np.zeros(len(x.texts), bool))]
    quality.rejected(s, rules)
    assert not seen


def test_quality_keeps_columns_and_takes_no_rows(docs, empty, rows):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(plain.quality(t)[-1] for _, t in pairs(rows)) > 0
    assert quality.quality(empty).count() == quality.keep_good(empty).count() == 0


# ---- tokens ----


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(docs, rows, library):
    want = Counter()
    for i, t in pairs(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    out = bpe.decode(bpe.encode(docs, PATH), PATH, into="decoded")
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out.select("doc_id", "ids", "decoded").collect()) == want
    at_once = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in at_once) == want and set(docs.columns) < set(at_once[0].asDict())
    trip = got(bpe.round_trip(docs, PATH), "doc_id", "n_tokens", "decoded_sha256")
    assert trip == Counter({(i, len(ids), plain.sha(d)): n for (i, ids, d), n in want.items()})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="abcdeéß'’.,!? 12\n<|endoftx>", max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    state = bpe.worker_state("test")
    if not state:
        state.update(coder=bpe.PairCoder(bpe.vocabulary_text(PATH)), library=Tokenizer.from_file(PATH))
    want = state["library"].encode(text, add_special_tokens=False).ids
    for encode_new in (state["coder"].encode_words, tokens.library(bpe.vocabulary_text(PATH)).encode_new):
        ids, starts = texts.encoded(pa.array([text, None]), texts.WordTable(encode_new, most=50))
        assert ids.tolist() == want and starts.tolist() == [0, len(want), len(want)]


def test_only_failing_words_are_merged():
    coder = bpe.PairCoder(bpe.vocabulary_text(PATH))
    rng = random.Random(3)
    pieces = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    assert coder.encode_pieces(pieces) == [coder.merged(coder.symbols(p, True)) for p in pieces]
    assert all(coder.merged(s()) == coder.merged_by_heap(s()) for p in pieces for s in [lambda p=p: coder.symbols(p, True)])
    calls, merged = [], coder.merged
    coder.merged = lambda ids: calls.append(ids) or merged(ids)
    coder.judged.clear()
    assert coder.encode_pieces(["the"] * 50) == [[coder.ids["the</w>"]]] * 50
    assert len(calls) == 1


def test_token_files(spark, docs, empty, rows, library):
    folder = tokens.write_tokens(docs, tokens.token_folder(spark), PATH, files=4)
    out = tokens.read_tokens(spark, folder)
    have = sorted((r.start, r.doc_id, list(r.tokens)) for r in out.collect())
    ordered = sorted(pairs(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((start, i, ids))
        start += len(ids)
    assert have == want
    import pyarrow.parquet as pq

    files = [f for f in spark.read.parquet(folder).inputFiles()]
    column = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0)
    by_name = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert by_name["doc_id"].has_offset_index and by_name["tokens.list.element"].has_offset_index
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and by_name["tokens.list.element"].has_dictionary_page
    none = tokens.write_tokens(empty, tokens.token_folder(spark), PATH)
    assert tokens.checksums(tokens.read_tokens(spark, none)).count() == 0


# ---- repeats ----


@pytest.mark.parametrize(("heavy", "slice_bytes", "group_bytes"), [(20_000, 8 << 20, 8 << 20), (20_000, 2000, 3000), (0, 2000, 3000)])
def test_repeated_passages(docs, rows, monkeypatch, heavy, slice_bytes, group_bytes):
    monkeypatch.setattr(repeats, "HEAVY_PARTS", heavy)
    monkeypatch.setattr(repeats, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(texts.slices, "__defaults__", ("text", slice_bytes))
    out = got(repeats.without_repeats(docs), "doc_id", "n_words", "n_removed", "kept")
    assert out == Counter(plain.repeats(pairs(rows)))
    assert any(r[2] for r in out)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 1500])
def test_line_dedup(docs, rows, monkeypatch, slice_bytes):
    monkeypatch.setattr(texts.slices, "__defaults__", ("text", slice_bytes))
    want = plain.line_dedup(pairs(rows))
    assert got(lines.line_digest(docs), "doc_id", "n_lines", "n_removed", "text") == Counter(want)
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    stays = Counter((i, t if removed else original) for (i, _, removed, t), (_, original) in zip(want, pairs(rows), strict=True) if not removed or plain.words(t))
    assert got(kept, "doc_id", "text") == stays


def test_repeats_of_no_rows(empty):
    assert repeats.without_repeats(empty).count() == lines.line_digest(empty).count() == 0
    assert lines.without_repeated_lines(empty).count() == 0


def test_lines_within_one_edit():
    rng = random.Random(4)
    for _ in range(2000):
        a = tuple(rng.choices("ab", k=rng.randint(1, 7)))
        b = tuple(rng.choices("ab", k=rng.randint(1, 7)))
        assert lines.within_one_edit(list(a), list(b)) == plain.one_edit(a, b)


# ---- near duplicates ----


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    out = got(minhash.near_duplicates(docs, size, percent / 100), "doc_id", "n_shingles", "component_id", "kept")
    assert out == Counter(plain.near(pairs(rows), size, percent))


def test_groups_of_near_copies_lose_no_link(spark):
    """Variants of one text, many of which are linked only through others, and none through the smallest id."""
    rng = random.Random(9)
    base = plain.prose(rng, 150).split()
    data = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(len(w)), min(i % 14, 9)):
            w[k] = f"v{rng.randint(0, 400)}"
        data.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = got(minhash.near_duplicates(df, 3, 0.85), "doc_id", "n_shingles", "component_id", "kept")
    want = plain.near(data, 3, 85)
    assert out == Counter(want) and 1 < len({w[2] for w in want}) < 110


@pytest.mark.parametrize("most", [2, 1])
def test_texts_of_no_bucket_do_not_move(spark, monkeypatch, most):
    """The texts for verification are found without a shuffle of all texts while the ids are few; the groups are the same either way."""
    rng = random.Random(4)
    data = [(i, plain.prose(rng, 60)) for i in range(40)]
    data.append((100, data[7][1] + " more"))
    plans, stage = {}, minhash.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(minhash, "stage", noted)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_IDS", most, raising=False)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with ids beyond it
    try:
        out = got(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 0.85), "doc_id", "n_shingles", "component_id", "kept")
    finally:
        spark.conf.set(key, before)
    assert out == Counter(plain.near(data, 3, 85))
    assert ("SortMergeJoin" in plans["minhash-texts"]) == (most < 2)


def test_texts_with_the_same_rare_shingles_meet_once(spark, monkeypatch):
    rng = random.Random(9)
    base = plain.prose(rng, 150).split()
    data = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(len(w)), min(i % 14, 9)):
            w[k] = f"v{rng.randint(0, 400)}"
        data.append((1000 - i, " ".join(w)))
    groups, stage = {}, minhash.stage

    def noted(df, name):
        out = stage(df, name)
        if name == "minhash-rare":
            key = "having" if "having" in out.columns else "shingle"
            for r in out.select(key, "id").collect():
                groups.setdefault(r[0], set()).add(r[1])
        return out

    monkeypatch.setattr(minhash, "stage", noted)
    out = got(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 0.85), "doc_id", "n_shingles", "component_id", "kept")
    assert out == Counter(plain.near(data, 3, 85))
    assert groups and len({frozenset(g) for g in groups.values()}) == len(groups) and all(2 <= len(g) <= minhash.RARE for g in groups.values())


def test_no_near_duplicates_in_no_rows(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: top(x) for x in parent}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)))
    s = minhash.signatures(np.concatenate((a, b)), np.array([0, 1000, 2000]), 1000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


# ---- benchmark ----


def test_contamination(spark, docs, empty, rows):
    benchmark = spark.createDataFrame([(*r, "x") for r in plain.items()], "item_id long, text string, doc_id string")
    want = plain.contaminated(pairs(rows), plain.items())
    assert len(want) >= 6
    for block_chars in (1 << 20, 300):
        assert got(contamination.contaminated(docs, benchmark, block_chars=block_chars), "doc_id", "item_id", "distance") == want
    clean = contamination.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert got(clean, "doc_id", "text") == Counter(r for r in pairs(rows) if not any(k[0] == r[0] for k in plain.contaminated([r], plain.items())))
    assert contamination.contaminated(empty, benchmark).count() == contamination.contaminated(docs, benchmark.where("false")).count() == 0


def test_short_items_occur_word_for_word(spark):
    texts = ["A  Capital of\nFrance", "the capital of frances", "capital of", "ofrance capital of france!", "", None, "x capital\tof France x capital of france"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "Capital of France"), (2, "capital"), (None, "  "), (3, "capital of"), (1, "capital  of france")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = plain.contaminated(list(enumerate(texts)), items)
    assert want[0, 1, 0] == want[6, 1, 0] == want[2, 3, 0] == 1 and (1, 1, 0) not in want and (3, 1, 0) not in want
    for block_chars in (1 << 20, 4):
        assert got(contamination.contaminated(docs, benchmark, block_chars=block_chars), "doc_id", "item_id", "distance") == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=80))
def test_bit_parallel_distance(item, text):
    assert contamination.best_distance(item, text)[0] == plain.substring_distance(item, text)


# ---- perplexity ----


def brute_probability(train: list[str], gram: str, order: int) -> float:
    """Interpolated modified Kneser-Ney from its definition."""
    pad = perplexity.BEGIN * (order - 1)
    top = Counter(s[i : i + order] for s in (pad + t + perplexity.END for t in train) for i in range(len(s) - order + 1))
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    n1_to_4 = {n: [sum(c == i for c in levels[n].values()) for i in range(5)] for n in levels}

    def p(gram: str) -> float:
        n = len(gram)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        _, n1, n2, n3, n4 = n1_to_4[n]
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

    return p(gram)


def test_perplexity_follows_the_definition(spark):
    rng = random.Random(6)
    train = [plain.prose(rng, 30) for _ in range(12)]
    trusted = spark.createDataFrame([(t, "en") for t in train], "text string, lang string")
    folder, shards = perplexity.write_model(perplexity.model_rows(perplexity.gram_counts(trusted)), tokens.token_folder(spark) + "-model")
    text = "an ander ouqth 日ß"
    df = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, " ", "en"), (4, "xx", "de")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in perplexity.scored(df, folder, shards).collect()}
    s = perplexity.BEGIN * (perplexity.ORDER - 1) + text + perplexity.END
    logs = [np.log(brute_probability(train, s[i - perplexity.ORDER + 1 : i + 1], perplexity.ORDER)) for i in range(perplexity.ORDER - 1, len(s))]
    assert out[1].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    assert out[1].n_chars == len(text) and out[2].perplexity is None and out[3].perplexity is None and out[4].perplexity == pytest.approx(1e4, rel=1e-3)


def test_perplexity_tells_prose_from_noise(spark, docs, empty):
    rng = random.Random(8)
    good = [(i, plain.prose(rng, 120), "en") for i in range(200)]
    noise = [(1000 + i, "".join(rng.choice("#$%&ABCXYZ123 ") for _ in range(600)), "en") for i in range(40)]
    df = spark.createDataFrame(good + noise, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1000, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in perplexity.quality_by_perplexity(df, labels).collect()}
    held_out = [out[i] for i in range(120, 200)]
    assert sum(held_out) >= 78 and not any(out[1000 + i] for i in range(40))
    assert perplexity.quality_by_perplexity(empty, labels).count() == 0
    unlabelled = perplexity.quality_by_perplexity(docs, labels.where("false")).collect()
    assert len(unlabelled) == docs.count() and all(r.kept == (r.perplexity is not None) for r in unlabelled)


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    data = [("en" if i % 3 else "fr", rng.uniform(2, 9)) for i in range(1000)]
    out = {r.lang: r.threshold for r in perplexity.thresholds(spark.createDataFrame(data, "lang string, perplexity double"), 0.9, 1.0).collect()}
    for lang in ("en", "fr"):
        values = sorted(v for k, v in data if k == lang)
        assert out[lang] == pytest.approx(values[int(np.ceil(0.9 * len(values))) - 1], rel=2e-3)


# ---- pipeline ----


def test_pipeline_against_plain_stages(spark, rows, tmp_path, library):
    spark.createDataFrame(rows, plain.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(plain.items(), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [r for r in pairs(rows) if plain.quality(r[1])[-1]]
    left = [(i, t if n else original) for (i, _, n, t), (_, original) in zip(plain.line_dedup(left), left, strict=True) if not n or plain.words(t)]
    verdict = plain.near(left, 5, 80)
    gone = {i for i, _, _, kept in verdict if not kept}
    left = [r for r in left if r[0] not in gone]
    left = [r for r in left if not plain.contaminated([r], plain.items())]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter((i, t, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in left)
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in out) == want and want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokens"]
