"""The registered queries of this package: every operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    classifier, decontaminate, filter_audit, html_text, near_dedup, packing, phrases, quality_rules, repeats, secrets, sharding, url_filter, warc,
)
from tidemark.llm.common import Scratch
from tidemark.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("row.doc_id", *out.columns[1:])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(
        _table(spark, sf_dir, "documents"), Scratch(spark, "op2"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))
    return out.select("row.doc_id", *out.columns[1:])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is `rows`: shard sizes differ by one row at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = sharding.shuffle(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"), columns)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.match(_table(spark, sf_dir, "pages"), rules, Scratch(spark, "op4"), ["page_id"])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"), Scratch(spark, "op5", "zstd")).drop("bundle", "frame", "offset")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the 400-byte strings of the contract it tells of passages of over 50 words, which are often shorter."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"), Scratch(spark, "op8", "zstd"), ["doc_id"], words=51)
    return out.select("row.doc_id", *out.columns[1:])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(
        _table(spark, sf_dir, "documents"), Scratch(spark, "op9"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("row.doc_id", *out.columns[1:])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no URL: their source is the host, source and language the path below it."""
    out = classifier.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op10"), ["doc_id"],
        F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.select("row.doc_id", *out.columns[1:])


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op12"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"), Scratch(spark, "op13"), ["doc_id"])
    return out.select("row.doc_id", *out.drop("links").columns[1:])


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "op4_url_filters": op4_url_filters,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_suffix_array": op8_suffix_array,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrases": op11_phrases,
    "op12_filter_audit": op12_filter_audit,
    "op13_secrets": op13_secrets,
}
ORACLE: dict[str, str] = {
    "op4_url_filters": """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules
     WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule
  FROM parts
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM judged LEFT JOIN rules ON rule = rh || rp
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op11_phrases": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= 10)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r,
    CAST(1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS sub
    FROM best WHERE m = 3) GROUP BY lang, sub),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.sub = b.phrase
  WHERE m = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS before FROM o, i),
r AS (
  SELECT part, o, step, f,
    sum(CASE WHEN NOT passed OR fails[f] THEN 0 ELSE n END) AS kept, sum(CASE WHEN passed AND fails[f] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT passed AND fails[f] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda z: z)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN passed AND fails[f] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN passed AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT c.*, s.*, len(list_filter(before, lambda z: fails[z])) = 0 AS passed FROM c, s) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda z: chr(CAST(64 + z AS INT))), '') AS filter_order, CAST(step AS INT) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
""",
    "op13_secrets": r"""
WITH kinds(k, kind, role, pattern, grp, least, alone) AS (VALUES
  (0, 'assign', 's', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6, true),
  (1, 'access', 'i', 'AKIA[A-Z0-9]+', 0, 20, true),
  (2, 'hex', 's', '[0-9a-f]+', 0, 24, true),
  (3, 'user', 'i', '(?i:(user|username|login|client_?id|account|key_?id))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@-]+)', 2, 3, false),
  (4, 'key', 's', '[A-Za-z0-9+/]{32,}={0,2}', 0, 32, false),
  (5, 'endpoint', 'e', '(?i:(https?|wss?|ftps?|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|s3))://[^\x00-\x20"''<>]+', 0, 1, false)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT rid, k, regexp_extract_all(text, pattern, 0) AS m, regexp_extract_all(text, pattern, grp) AS v, regexp_split_to_array(text, pattern) AS gaps
  FROM docs, kinds WHERE regexp_matches(text, pattern)),
flat AS (SELECT rid, k, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(gaps[1:len(m)]) AS gap FROM raw),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM flat),
spans AS (
  SELECT rid, k, kind, role, alone, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e
  FROM placed JOIN kinds USING (k)
  WHERE length(v) >= least AND (kind <> 'key' OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')))),
free AS (
  SELECT * FROM spans a WHERE alone OR role = 'e' OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.rid = a.rid AND b.s < a.e AND b.e > a.s AND (b.alone OR (a.role = 's' AND b.role = 'e')))),
pairs AS (SELECT a.rid, a.k, a.s, a.role, b.role AS other, b.k AS bk, b.s AS bs FROM free a JOIN free b ON b.rid = a.rid AND b.s <= a.e + 200 AND b.e >= a.s - 200),
ok AS (SELECT DISTINCT rid, k, s FROM pairs WHERE role = 's' AND other = 'i'),
told AS (
  SELECT rid, k, s FROM free WHERE alone UNION SELECT rid, k, s FROM ok
  UNION SELECT rid, k, s FROM pairs WHERE role = 'i' AND other = 's'
  UNION SELECT p.rid, p.k, p.s FROM pairs p JOIN ok ON ok.rid = p.rid AND ok.k = p.bk AND ok.s = p.bs WHERE p.role = 'e'),
texts AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (alone) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM told JOIN spans USING (rid, k, s) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN texts USING (rid)
""",
}
