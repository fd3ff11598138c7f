"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.chat import format_chats
from foliant.llm.decontaminate import find_leaks
from foliant.llm.divergence import audit_sources
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.fill_middle import fill_in_middle, restored
from foliant.llm.jaccard_join import jaccard_components
from foliant.llm.line_dedup import line_dedup
from foliant.llm.lm_scoring import lm_scores
from foliant.llm.mixing import mix, taken
from foliant.llm.suffix_dedup import suffix_dedup
from foliant.llm.token_records import token_records
from foliant.llm.toxicity import toxicity
from foliant.llm.url_filter import filter_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    shards = F.array_distinct(F.col("draws.shard"))
    return mixed.select("doc_id", "size", "source_size", "target", taken(F.col("draws")).alias("taken"), F.array_sort(shards).alias("shards"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "severity", "grade", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output", F.col("output").cast("string"))
    digest = lambda text, name: F.sha2(text.cast("binary"), 256).alias(name)
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output"), "output_sha256"), digest(again, "restored_sha256"))


#: host, path and verdict of the rules of op12_url_filter.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_score": op3_lm_score,
    "op4_token_records": op4_token_records,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_url_filter": op12_url_filter,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
          first_value(doc_id) OVER w AS keep_id,
          count(*) OVER (PARTITION BY norm) AS group_size,
          row_number() OVER w = 1 AS kept,
          sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
    """,
    "op10_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
        l AS (
          SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
          FROM d WHERE text IS NOT NULL),
        t AS (SELECT r, k, source, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS name FROM l),
        bad AS (
          SELECT name FROM t WHERE name <> '' GROUP BY name
          HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
        g AS (
          SELECT r, count(*) AS n_lines, count(*) FILTER (bad.name IS NOT NULL) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (bad.name IS NULL), '') AS clean
          FROM t LEFT JOIN bad ON t.name = bad.name GROUP BY r)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
          length(clean) AS n_chars, md5(clean) AS clean_md5
        FROM d LEFT JOIN g ON d.r = g.r
    """,
    "op11_fill_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
          FROM documents),
        k AS (
          SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM d),
        c AS (
          SELECT *, least(a, b) AS p, greatest(a, b) AS q, substring(text, 1, least(a, b)) AS prefix,
            substring(text, least(a, b) + 1, abs(a - b)) AS middle, substring(text, greatest(a, b) + 1) AS suffix
          FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
          sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
          sha256(text) AS restored_sha256
        FROM c
    """,
    "op12_url_filter": r"""
        WITH p AS (
          SELECT row_number() OVER () AS r, page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        u AS (
          SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) u(h, q, verdict)),
        best AS (
          SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
          FROM p JOIN u ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.r = best.r
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        t AS (
          SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
          FROM d),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        g AS (
          SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) g
          LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
        p AS (
          SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + CAST(CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5) // (n + 5 * v) AS BIGINT) AS p
          FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
        q AS (
          SELECT l.lang, l.term, 1 + CAST(CAST(1000000000 AS HUGEINT) * (l.c + 5) // (l.n + 5 * v) AS BIGINT) AS q
          FROM (SELECT lang, term, c, sum(c) OVER (PARTITION BY lang) AS n FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term)) l JOIN v ON l.lang = v.lang),
        f AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x
            ON a.lang = x.lang AND a.source = x.source AND b.source = x.item
          UNION ALL
          SELECT p.lang, source, 'term', p.term, p - q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
    """,
}
