"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, langid, media, mixing, negatives, packing, periodic, quality, simhash, substrings, tokens, toxicity, urls
from .common import crc_bucket, table

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_bucket("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("difference")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"))
    return rated.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.filter(crc_bucket("doc_id", 3) != 1))
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_toxicity, op3_source_mix, op4_token_counts, op5_media_columns, op6_simhash_near_dedup, op7_url_filter, op8_quality_rules, op9_language_id, op10_best_fit_packing, op11_hard_negatives, op12_substring_dedup, op13_periodic_runs)
}
_SAYS_NOTICE = " OR ".join(f"contains(low, '{wording}')" for wording in quality.NOTICES)

#: The rules again, plainly: no flags for whole texts, and windows compared as strings.
OP8_SQL = (
    r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
 grams AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
 rep AS (SELECT rid, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM twice) GROUP BY rid),
 l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 u AS (SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
   len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, lower(line) AS low FROM (SELECT rid, unnest(list_distinct(lines)) AS line FROM l)),
 good AS (SELECT rid, sum(chars) AS kept_chars FROM u WHERE NOT (
   (n >= 3 AND 4 * (length(line) - length(translate(line, '|»›·•', ''))) >= n)
   OR length(line) - length(translate(line, '#*$%&|<>', '')) > 0.15::DOUBLE * n
   OR length(line) - length(replace(line, '!!', '')) > n
   OR (n >= 5 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}'))
   OR (n >= 40 AND NOT regexp_matches(line, '[.!?,;:…。！？]'))
   OR ("""
    + _SAYS_NOTICE
    + r""")) GROUP BY rid),
 f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM w JOIN l USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)"""
)

#: Every anchor against every row.
OP11_SQL = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank
   FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

#: Every window as a string.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
 w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i, words FROM d),
 g AS (SELECT rid, i, word, CASE WHEN i + 34 <= len(words) THEN array_to_string(words[i:i + 34], ' ') END AS gram FROM w),
 c AS (SELECT rid, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY gram) > 1 AS twice FROM g),
 k AS (SELECT rid, i, word, coalesce(i - max(CASE WHEN twice THEN i END) OVER (PARTITION BY rid ORDER BY i) <= 34, FALSE) AS gone FROM c),
 t AS (SELECT rid, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (rid)"""

#: The others are beyond SQL: parsed HTML, fitted models, a tokenizer, stored files, XXH64, maximal runs.
ORACLE_SQL: dict[str, str] = {"op8_quality_rules": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_substring_dedup": OP12_SQL}
