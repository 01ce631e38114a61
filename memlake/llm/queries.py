"""The queries of these operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bestfit, collocations, decontamination, extraction, jaccard, language, licenses, packing, resampling, rules, sharding, trie, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(_read(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.scored(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), "n_bytes", F.col("score").alias("tree_score"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.feistel_shards(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_fit_packed(_read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_license_scan, op4_html_extraction, op5_quality_rules, op6_url_filter, op7_ngram_jaccard_join, op8_packing, op9_lm_scoring, op10_sharding, op11_conversation_prefix_trie, op12_best_fit_packing, op13_phrase_collocations)}


_WORDS = r"[^\x20\x09-\x0D]+"

SQL = {
    "op2_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + 9] AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(t) AS n FROM win),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
grams AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM words),
p AS (SELECT doc_id, i, n, g[1:n] AS t FROM grams, lens WHERE len(g) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, win.item FROM p JOIN win ON p.t = win.t),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hits) GROUP BY doc_id),
freq AS (SELECT x, count(*) AS c FROM words GROUP BY 1),
rare AS (SELECT t, arg_min(x, (coalesce(c, 0), x)) AS x FROM (SELECT DISTINCT t, unnest(t) AS x FROM win) LEFT JOIN freq USING (x) GROUP BY 1),
near AS (SELECT words.doc_id, count(DISTINCT win.item) AS n_near_items FROM words JOIN rare USING (x) JOIN d USING (doc_id) JOIN win ON win.t = rare.t WHERE list_has_all(d.w[greatest(words.i - 10, 1):words.i + 10], rare.t) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM d)),
n AS (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, len(regexp_extract_all(line, '[#*$%&|<>{}\[\]\\^~=_+/]')) AS marks FROM l),
f AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
(marks > 0.1 * strlen(line) AND marks > 2) OR (n < 10 AND NOT regexp_matches(line, '[.!?;:]|…|。|！|？')) OR (marks > 0 AND len(regexp_extract_all(line, '[|]|»|›|•|·| [>/] ')) > greatest(2, 0.15 * n))
OR (n < 40 AND regexp_matches(line, 'all rights reserved|cookie (policy|notice|settings)|uses cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our|sign up for our|powered by|licen[cs]ed under|copyright \W*[0-9]{4}', 'i')) AS fails FROM n WHERE n > 0),
lines AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (again OR fails) AS n_lines_failed, coalesce(sum(n) FILTER (again OR fails), 0)::BIGINT AS n_words_lost FROM f GROUP BY 1),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w) WHERE i + 2 <= len(w)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) o(k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_failed, 0)::BIGINT AS n_lines_failed, coalesce(n_words_lost, 0)::BIGINT AS n_words_lost FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_lost <= 0.5 * n_words AS kept FROM m""",
    "op13_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) s(k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, j.i, array_to_string(w[1:j.i], ' ') AS x, array_to_string(w[j.i + 1:], ' ') AS y FROM c JOIN (VALUES (1), (2)) j(i) ON j.i < c.k),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, i, fx.c AS l, fy.c AS r, ((1000000::HUGEINT * a * a) // (fx.c::HUGEINT * fy.c))::BIGINT AS score
FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON best.k = 2 AND longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
