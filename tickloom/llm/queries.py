"""The queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.driver_tables import table
from tickloom.llm import ann, decontaminate, divergence, filter_audit, langid, licenses, mixing, packing, quotes, simhash, suffix_dedup, syncmers, warc


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text_model(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(table(spark, sf_dir, "conversations"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_syncmers, op2_simhash, op3_mix_sources, op4_suffix_dedup, op5_license_scan, op6_language_id, op7_warc,
        op8_pack_documents, op9_nearest, op10_chat_quotes, op11_filter_audit, op12_source_divergence, op13_decontaminate,
    )
}

ORACLE_SQL = {
    "op3_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, sum(2 * source_size) OVER before AS capped, sum(w) OVER rest AS weight_left,
         sum(source_size) OVER () AS total
  FROM s
  WINDOW before AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT max(level) AS level FROM (
    SELECT (1.5 * total::DOUBLE - coalesce(capped, 0)::DOUBLE) / weight_left::DOUBLE AS level,
           source_size, w FROM c
  ) WHERE level * w < 2 * source_size
), t AS (
  SELECT source, source_size, least(2.0 * source_size::DOUBLE, level * w)::DOUBLE AS target FROM s, l
), r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p,
         CASE WHEN rate > floor(rate) THEN u / (1 - u) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q
  FROM r
), b AS (
  SELECT *, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q
), k AS (
  SELECT *, least(whole + CASE WHEN before + size / 2.0 < p * source_size THEN 1 ELSE 0 END, 2)::BIGINT AS copies FROM b
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM k
""",
    "op11_filter_audit": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lowest FROM t
), m AS (
  SELECT part, doc_id,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > lowest THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask
), o(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step::INTEGER AS step, (1 << (ascii(substr(filter_order, step, 1)) - 65))::INTEGER AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INTEGER AS before
  FROM o, (VALUES (1), (2), (3), (4), (5)) k(step) WHERE length(filter_order) = 5
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT no, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT no) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(whole) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // ((sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT + 5 * v.v) AS p,
         1 + (1000000000 * (k.whole + 5)::HUGEINT) // (v.total::HUGEINT + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 50
""",
    "op13_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), i AS (
  SELECT *, least(10, len(words)) AS n FROM b WHERE len(words) > 0
), x AS (
  SELECT DISTINCT item, n, array_to_string(words[p:p + n - 1], ' ') AS win
  FROM (SELECT item, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM i)
), y AS (
  SELECT no, p, l.n AS n, array_to_string(words[p:p + l.n - 1], ' ') AS win
  FROM (SELECT no, words, unnest(range(1, len(words) + 1)) AS p FROM d), (SELECT DISTINCT n FROM x) l
  WHERE p + l.n - 1 <= len(words)
), h AS (
  SELECT y.no, y.p AS first, x.n, x.item FROM y JOIN x ON y.n = x.n AND y.win = x.win
), w AS (
  SELECT no, count(DISTINCT p) AS n_hit FROM (SELECT no, unnest(range(first, first + n)) AS p FROM h) GROUP BY no
), z AS (
  SELECT no, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT no, item FROM h) GROUP BY no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON d.no = w.no LEFT JOIN z ON d.no = z.no
""",
}
