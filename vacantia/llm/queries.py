"""Queries of the operators over the given tables, and their expected rows in DuckDB SQL where SQL can state them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import alignment, archives, bpe, contamination, extraction, lines, minhash, periods, perplexity, quality, repeats, simhash, tokens
from vacantia.llm.texts import Words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def counted(pattern: str) -> str:
    return f"length(regexp_replace(joined, '{pattern}', '', 'g'))"


QUALITY_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
m AS (SELECT *, len(w)::BIGINT AS n_words, array_to_string(w, '') AS joined FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) > 2),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
d AS (SELECT rid, sum(c - 1)::BIGINT AS n_dup_lines, sum(c)::BIGINT AS n_lines FROM l GROUP BY rid),
b AS (SELECT doc_id, w, n_words, length(joined)::BIGINT AS word_chars, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {counted('[^#*$%&|<>]')}::BIGINT AS n_symbols,
        {counted('[^!?]')} AS marks, {counted('[^\\p{Lu}]')} AS capitals, {counted('[^\\p{L}]')} AS letters
      FROM m LEFT JOIN r USING (rid) LEFT JOIN d USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 8 * n_words OR 10 * capitals > 4 * letters OR 4 * marks > n_words) AS kept
FROM f
"""


@query(QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"))


@query()
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = tokens.write_tokens(table(spark, sf, "documents"), tokens.token_folder(spark), tokenizer_path())
    return tokens.checksums(tokens.read_tokens(spark, folder))


@query()
def op5_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), tokenizer_path())


SHINGLES_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, t.doc_id = r.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


@query(SHINGLES_SQL)
def op10_minhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), size=3, similarity=0.85)


REPEATS_SQL = f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM again)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""


@query(REPEATS_SQL)
def op7_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM l),
f AS (SELECT w, len(w) AS n, min((doc_id, i)) AS first FROM m WHERE len(w) >= 1 GROUP BY w),
v AS (SELECT w, first, i AS place, w[1:i - 1] || w[i + 1:] AS v FROM (SELECT w, first, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8)
  UNION ALL SELECT w, first, -1, w FROM f WHERE n >= 8),
best AS (SELECT v, place, min(first) AS best FROM v GROUP BY v, place),
cut AS (SELECT v, min(best) AS best FROM best WHERE place > 0 GROUP BY v),
beaten AS (SELECT w FROM v JOIN best USING (v, place) WHERE place > 0 AND best < first
  UNION SELECT x.w FROM v x JOIN best b ON b.v = x.v AND b.place = -1 WHERE x.place > 0 AND b.best < x.first
  UNION SELECT x.w FROM v x JOIN cut c ON c.v = x.v WHERE x.place = -1 AND c.best < x.first),
r AS (SELECT m.doc_id, m.i, m.line, coalesce(f.first <> (m.doc_id, m.i) OR f.w IN (SELECT w FROM beaten), false) AS gone FROM m LEFT JOIN f ON f.w = m.w)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""


@query(LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.line_digest(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS original,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM b
"""


@query(ARCHIVE_SQL)
def op4_warc_packages(spark: SparkSession, sf: str) -> DataFrame:
    packages = archives.write_packages(table(spark, sf, "pages"), archives.package_folder(spark))
    return archives.read_packages(packages)


@query()
def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: The given pages mark their article; SQL cuts it out and reads its paragraphs.
PAGES_SQL = """
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


@query(PAGES_SQL)
def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(table(spark, sf, "pages"))


@query()
def op3_perplexity_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.quality_by_perplexity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), groups="sha256")


@query()
def op12_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf, "documents"), size=4)
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def with_planted_periods(ids: list, words: Words) -> np.ndarray:
    """Word numbers in which about every tenth text, by the hash of its id, is periodic from some word on."""
    codes = words.codes.copy()
    for doc_id, begin, end in zip(ids, words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        h, n = zlib.crc32(str(doc_id).encode()), end - begin
        if doc_id is not None and h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            codes[begin + a : end] = codes[begin + a + np.arange(n - a) % p]
    return codes


#: Equal words q apart in a row make a run of period q; the smallest q counts. The checksum is taken bit by bit.
PERIODS_SQL = f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS h FROM t),
a AS (SELECT *, CASE WHEN n > 0 THEN h // 10 % n END AS a, 3 + h // 10 % 8 AS k FROM c),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1)::BIGINT]) ELSE w END AS w, n FROM a),
word AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
pair AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND u.i < v.i AND 4 * (v.i - u.i) <= u.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) GROUP BY doc_id, q, g),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
r AS (SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, -best[2]::BIGINT AS start, best[1]::BIGINT AS length, -best[3]::BIGINT AS period,
  (1000 * best[1] // -best[3])::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query(PERIODS_SQL)
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = periods.periodic_runs(table(spark, sf, "documents"), rewrite=with_planted_periods)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
