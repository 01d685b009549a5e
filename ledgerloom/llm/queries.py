"""Registered queries of this subpackage: thin uses of its operators on whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, licences, linededup, media, neardup, negatives, packing, prefixtrie, rules, simhash, topk, toxicity, urlfilter
from ledgerloom.llm.triesql import TRIE_SQL
from ledgerloom.llm.urlsql import url_sql

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
QUALITY_CUT, TOXICITY_CUT = 0.3, 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(_table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def quality_model(spark: SparkSession, sf_dir: str) -> rules.RuleEnsemble:
    return rules.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(_fold(5) != 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.score(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_columns(_table(spark, sf_dir, "documents"))
    size = F.octet_length("payload")
    return got.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.templates(spark))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(_table(spark, sf_dir, "documents"), least_words=1)
    return got.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), " ").alias("removed"), F.md5("text").alias("text_md5"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    known = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlfilter.judge_urls(pages, known, urlfilter.html_links(pages)).drop("component")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> tuple:
    return toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(_fold(3) != 1))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= TOXICITY_CUT).cast("int").alias("predicted"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations"), lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_bpe, op3_quality, op4_media, op5_topk, op6_licences, op7_lines, op8_urls, op9_neardup, op10_toxicity, op11_simhash, op12_negatives, op13_trie)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WORDS = "string_split(trim(regexp_replace(translate({0}, '" + urlfilter.UPPER + "', '" + urlfilter.LOWER + "'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

ORACLE = {
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_licences": f"""
        WITH t0(template, licence, text) AS (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(licences.TEMPLATES))}),
             t1 AS (SELECT template, licence, {_WORDS.format("text")} AS w FROM t0), t AS (SELECT template, licence, {_BIGRAMS.format("w")} AS b FROM t1),
             l AS (SELECT doc_id, string_split(text, chr(10)) AS p, text FROM documents WHERE text IS NOT NULL),
             u0 AS (SELECT doc_id, i - 1 AS line, p[i] AS unit FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM l)
                    UNION ALL SELECT doc_id, -1, text FROM l WHERE len(p) > 1),
             u1 AS (SELECT doc_id, line, {_WORDS.format("unit")} AS w FROM u0), u2 AS (SELECT doc_id, line, {_BIGRAMS.format("w")} AS b FROM u1),
             m AS (SELECT doc_id, line, template, licence, len(list_intersect(u2.b, t.b)) AS shared, len(u2.b) + len(t.b) AS total FROM u2 JOIN t
                   ON 200 * least(len(u2.b), len(t.b)) >= {licences.PERCENT} * (len(u2.b) + len(t.b))),
             g AS (SELECT doc_id, line, template, licence, round(2.0 * shared / total, 6)::DOUBLE AS dice FROM m WHERE 200 * shared >= {licences.PERCENT} * total),
             r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, template) AS k FROM g)
        SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_matches, r.line::INTEGER AS line, r.template::INTEGER AS template, r.licence, r.dice
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.k = 1""",
    "op8_urls": url_sql(URL_RULES),
    "op13_trie": TRIE_SQL,
    "op12_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
                   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""",
}
