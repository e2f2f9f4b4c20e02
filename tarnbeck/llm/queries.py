"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, layout, lines, lm, mixing, quality, simhash, toxicity
from .tables import read


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: the text, its digest, and what was removed."""
    cut = lines.dedup_lines(read(spark, sf_dir, "documents"))
    gone = F.aggregate(
        F.arrays_zip("removed_starts", "removed_ends"), F.lit(0), lambda n, x: n + x["removed_ends"] - x["removed_starts"]
    )
    return cut.select("doc_id", "text", F.md5("text").alias("digest"), gone.alias("removed_chars"), "removed_starts", "removed_ends")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    mixed = mixing.mix_sources(docs, mixing.label_domains(labels), mixing.TARGETS)
    shares = [F.col("domain_posterior")[d].alias(f"p_{d}") for d in mixing.TARGETS]
    return mixed.select("doc_id", "tokens", *shares, "rate", "copies")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and scores, rounded to what does not depend on the order of sums."""
    scored = lm.backoff_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "tokens", F.round("log_score", 4).alias("log_score"), F.round("score", 6).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract_text(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_lines": op2_lines,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ann": """
        WITH base AS (
            SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len([x for x in embedding if x <> 0]) > 0
                AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ),
        pairs AS (
            SELECT q.r, q.vec_id AS query_id, b.vec_id, b.r AS other, list_inner_product(q.v, b.v) AS score
            FROM base q JOIN base b ON q.r <> b.r AND len(q.v) = len(b.v)
            WHERE q.vec_id % 20 = 0
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS place FROM pairs)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
    """,
    "op7_lm": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7f])+') AS words
            FROM documents
        ),
        places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM texts),
        tokens AS (SELECT r, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS before FROM places),
        unigrams AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
        bigrams AS (SELECT before, w, count(*) AS n FROM tokens WHERE before IS NOT NULL GROUP BY before, w HAVING count(*) >= 2),
        total AS (SELECT sum(n) AS n FROM unigrams),
        scored AS (
            SELECT t.r, CASE WHEN t.before IS NULL THEN ln(u.n / total.n) WHEN b.n IS NOT NULL THEN ln(b.n / c.n)
                ELSE ln(0.4 * u.n / total.n) END AS s
            FROM tokens t CROSS JOIN total JOIN unigrams u ON u.w = t.w
            LEFT JOIN unigrams c ON c.w = t.before LEFT JOIN bigrams b ON b.before = t.before AND b.w = t.w
        ),
        sums AS (SELECT r, sum(s) AS s FROM scored GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS tokens, round(coalesce(s, 0.0), 4) AS log_score, round(s / len(words), 6) AS score
        FROM texts LEFT JOIN sums USING (r)
    """,
}
