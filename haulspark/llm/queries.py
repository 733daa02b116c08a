"""One registered query per operator, and the SQL where SQL can say the same.

Queries read whole tables with production parameters and derive the columns of
their contract from the operators' outputs.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm import alignment, bpe, collocations, packing, pii, quality, secrets, shuffle, simhash, substring, tiling, unigram, url_filter

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
KEY = "surrogate-key-1"
SHARDS = 16
END_OF_TEXT = {"<|endoftext|>": 50256}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; the list holds the urls of the pages whose id is divisible by 100."""
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, pages.filter(F.col("page_id") % 100 == 0))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(read(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(read(spark, sf_dir, "documents"), shingle=4, max_bits=4).drop("root")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read(spark, sf_dir, "documents"), unigram.read_pieces(public_tokenizers.path(PIECES)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read(spark, sf_dir, "documents")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "n_lines", "n_stop_words", "n_symbol_lines")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"), KEY)


def op10_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    done = shuffle.assign(docs, SHARDS)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                             public_tokenizers.path(PIECES))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_TEXT)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_substring_dedup, op3_simhash_dedup, op4_bpe_codec, op5_benchmark_tiling, op6_secret_scan,
    op7_token_counts, op8_quality_rules, op9_pii_surrogates, op10_uniform_shards, op11_phrase_collocations,
    op12_token_alignment, op13_best_fit_packing)}


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def op1_sql(rules=url_filter.DEFAULT_RULES) -> str:
    """Plain SQL: parse, take the longest fitting rule, else look the list up."""
    values = ", ".join(f"('{v}', '{h}', '{p}', '{h + p}')" for v, h, p in rules)
    return rf"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter._UPPER}', '{url_filter._LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^/?#]*[^?#]*\?([^#]*)', 1) AS query FROM parts),
args AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
    lambda a: a <> '' AND NOT regexp_matches(a, '{url_filter.TRACKING}'))), '&') AS kept_args FROM split),
canon AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '(\.?:(80|443)|\.|:)$', ''), '^www\.', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN kept_args <> '' THEN '?' || kept_args ELSE '' END END AS canonical_url FROM args),
rules(verdict, rhost, rpath, rule) AS (VALUES {values}),
ruled AS (
  SELECT page_id, canonical_url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM canon LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL),
listed AS (SELECT DISTINCT canonical_url AS url FROM canon WHERE page_id % 100 = 0 AND canonical_url IS NOT NULL),
asked AS (SELECT ruled.*, url IS NOT NULL AS found FROM ruled LEFT JOIN listed ON canonical_url = url)
SELECT p.page_id, a.host, a.path, a.rule,
       CASE WHEN a.rule IS NOT NULL THEN a.verdict WHEN a.found THEN 'block' ELSE 'allow' END AS verdict,
       a.canonical_url, CASE WHEN a.rule IS NULL THEN a.found END AS listed
FROM pages p JOIN asked a ON p.page_id = a.page_id"""


def op8_sql(table: str = "documents") -> str:
    stop = sorted({w for ws in quality.STOP_WORDS.values() for w in ws})

    def limits(rules) -> str:
        return " OR ".join(f"{m} {'>' if b == 'max' else '<'} {x}" for _, m, b, x in rules)

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END"

    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{quality.WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS lines
  FROM {table}),
win AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM again) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_symbol_lines,
         len(list_filter(words, lambda x: lower(x) IN {_list(stop)})) AS n_stop_words,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid),
r AS (
  SELECT *, {ratio('100.0 * n_repeat_words', 'n_words')} AS repeat_percent, {ratio('n_symbols', 'n_words')} AS symbol_ratio,
         {ratio('word_chars', 'n_words')} AS mean_word_length, {ratio('n_stop_words', 'n_words')} AS stop_ratio,
         {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('n_symbol_lines', 'n_lines')} AS symbol_line_ratio FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, ({limits(quality.BASE_RULES)}) AS base_failed,
       NOT ({limits(quality.BASE_RULES)} OR {limits(quality.RULES)}) AS kept, n_lines::BIGINT AS n_lines,
       n_stop_words::BIGINT AS n_stop_words, n_symbol_lines::BIGINT AS n_symbol_lines FROM r"""


def op11_sql(table: str = "documents", max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000) -> str:
    """Plain SQL: all n-grams counted, each cut scored, the least taken."""
    orders = range(2, max_words + 1)
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS m, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS phrase FROM p"
        for n in range(1, max_words + 1))
    cuts = " UNION ALL ".join(
        f"SELECT c.lang, c.m, c.phrase, c.a, {k} AS k, array_to_string(string_split(c.phrase, ' ')[1:{k}], ' ') AS first, "
        f"array_to_string(string_split(c.phrase, ' ')[{k + 1}:{n}], ' ') AS rest FROM c WHERE c.m = {n}"
        for n in orders for k in range(1, n))
    inside = " UNION ALL ".join(
        f"SELECT lang, {n} AS m, array_to_string(string_split(phrase, ' ')[{i + 1}:{i + n}], ' ') AS phrase, a FROM c WHERE m = {long}"
        for long in orders for n in range(2, long) for i in range(long - n + 1)) or "SELECT lang, m, phrase, a FROM c WHERE false"
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN_GROUP}') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {table}),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {min_count}),
s AS (
  SELECT x.lang, x.m, x.phrase, x.a, x.k, l.a AS l, r.a AS r,
         ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM ({cuts}) x JOIN f l ON l.lang = x.lang AND l.m = x.k AND l.phrase = x.first
  JOIN f r ON r.lang = x.lang AND r.m = x.m - x.k AND r.phrase = x.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, m, phrase, max(a) AS longest FROM ({inside}) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inside i USING (lang, m, phrase) WHERE coalesce(100 * i.longest < {share} * b.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""


ORACLE = {"op11_phrase_collocations": op11_sql(), "op1_url_filter": op1_sql(), "op8_quality_rules": op8_sql()}
