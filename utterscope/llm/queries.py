"""The registered queries of this subpackage and their SQL.

Each applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm import (
    approx_neighbors,
    bpe_codec,
    filter_audit,
    language,
    packing,
    passages,
    quality_rules,
    secrets,
    simhash,
    source_audit,
    suffix_dups,
    token_counts,
    vector_dups,
)
from utterscope.llm.common import bounded_batches, table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "documents")


@register("op1_passage_chains")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(documents(spark, sf_dir), min_words=50, similarity=0.8)


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), BYTE_VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@register("op3_bpe_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode_texts(documents(spark, sf_dir), BYTE_VOCABULARY)
    return bpe_codec.decode_ids(encoded, BYTE_VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@register("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_VOCABULARY).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.scan_secrets(documents(spark, sf_dir)))


@register("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_predict(documents(spark, sf_dir))


@register("op7_suffix_dups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dups.remove_repeats(documents(spark, sf_dir))
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                          F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_lsh_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rows(spark, sf_dir, "embeddings")
    return approx_neighbors.nearest(vectors, F.pmod("vec_id", F.lit(100)) == 0, k=10)


@register("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@register("op10_vector_dups")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(rows(spark, sf_dir, "embeddings"), threshold=0.9)


@register("op11_filter_audit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), rows(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH listed AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
labelled AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
             FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CAST(len(words) < 100 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) AS b,
           CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS INT) AS c,
           CAST(regexp_matches(body, '[#$%&*|]') AS INT) AS d,
           CAST(coalesce(l.doc_id > min(l.doc_id) OVER (PARTITION BY body), false) AS INT) AS e
    FROM listed l LEFT JOIN labelled g ON l.doc_id = g.doc_id),
masked AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
           FROM judged GROUP BY ALL),
survivors AS (
    SELECT p.part, s.subset, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good,
           CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic
    FROM (SELECT DISTINCT part FROM judged) p CROSS JOIN range(32) s(subset)
    LEFT JOIN masked m ON m.part = p.part AND (m.failed & s.subset) = 0 GROUP BY ALL),
letters AS (SELECT chr(CAST(65 + i AS INT)) AS f, CAST(1 AS BIGINT) << i AS own FROM range(5) t(i)),
orders AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.own, w.own, x.own, y.own, z.own] AS bits
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE v.own + w.own + x.own + y.own + z.own = 31 AND len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own,
                 CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
          FROM orders, range(1, 6) t(step)),
told AS (
    SELECT b.part, s.filter_order, s.step, s.own, t.n AS kept, b.n - t.n AS removed,
           z.n - o.n - (b.n - t.n) AS redundant, u.n - w.n AS unique_fails, b.good - t.good AS good_lost,
           b.toxic - t.toxic AS toxic_lost
    FROM steps s JOIN survivors b ON b.subset = s.before
    JOIN survivors t ON t.part = b.part AND t.subset = s.before + s.own
    JOIN survivors z ON z.part = b.part AND z.subset = 0
    JOIN survivors o ON o.part = b.part AND o.subset = s.own
    JOIN survivors u ON u.part = b.part AND u.subset = 31 - s.own
    JOIN survivors w ON w.part = b.part AND w.subset = 31)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""


@register("op12_source_audit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(documents(spark, sf_dir))


ORACLES["op12_source_audit"] = r"""
WITH read AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
grps AS (SELECT DISTINCT lang, source FROM read),
spread AS (SELECT doc, lang, source, unnest(terms) AS term FROM read),
kept AS (SELECT lang, term, count(*) AS total FROM spread GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counted AS (SELECT lang, source, term, count(*) AS n FROM spread GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
          FROM grps g JOIN kept k ON k.lang = g.lang
          LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
rated AS (
    SELECT lang, source, term, n,
           1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER own + count(*) OVER own) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (total + 1)) // (sum(total) OVER own + count(*) OVER own) AS q
    FROM dense WINDOW own AS (PARTITION BY lang, source)),
pairs AS (
    SELECT g.lang, g.source, h.source AS item,
           coalesce(v.value, 0) AS value
    FROM grps g JOIN grps h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
               FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
    ON v.lang = g.lang AND v.source = g.source AND v.item = h.source),
listed AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM rated WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@register("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(documents(spark, sf_dir))
