"""Queries of the numbered operators over their whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, mixing, near_dup, negatives, pieces, pii, quality, render, suffixes, tokens, topk, whitening
from .shared import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.train(spark))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract_text(table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=7)


def op12_piece_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_license_scan,
        op3_near_duplicates,
        op4_token_counts,
        op5_benchmark_hits,
        op6_html_text,
        op7_exact_top_k,
        op8_personal_data,
        op9_repeated_passages,
        op10_quality,
        op11_hard_negatives,
        op12_piece_digest,
        op13_whitened_embeddings,
    )
}

ORACLES = {
    "op1_mix_sources": r"""
        WITH rows AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
            FROM documents),
        sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
            FROM rows GROUP BY source),
        weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM sizes),
        sums AS (
            SELECT *, sum(source_size) OVER () AS total,
                   sum(weight) OVER () - sum(weight) OVER room + weight AS weight_from,
                   3 * (sum(source_size) OVER room - source_size) AS cap_before
            FROM weighed
            WINDOW room AS (ORDER BY source_size / weight, place ROWS UNBOUNDED PRECEDING)),
        marked AS (SELECT *, weight * (total - cap_before) >= 3 * source_size * weight_from AS filled FROM sums),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN filled THEN (3 * source_size)::DOUBLE
                        ELSE (total - sum(CASE WHEN filled THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE * weight
                             / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () END AS target
            FROM marked),
        plan AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets),
        hashes AS (
            SELECT source, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto
            FROM rows GROUP BY source, hash),
        edges AS (
            SELECT p.source, min(h.hash) AS hash, arg_min(h.size, h.hash) AS size, arg_min(h.upto - h.size, h.hash) AS before,
                   any_value(p.target - p.whole * p.source_size) AS rest
            FROM plan p JOIN hashes h ON p.source IS NOT DISTINCT FROM h.source
            WHERE h.upto > p.target - p.whole * p.source_size AND p.target - p.whole * p.source_size > 0
            GROUP BY p.source),
        limits AS (SELECT source, CASE WHEN size - (rest - before) < rest - before THEN hash + 1 ELSE hash END AS below FROM edges)
        SELECT r.doc_id, r.source, r.size, p.source_size, p.target,
               ((p.whole + CASE WHEN r.hash < coalesce(l.below, 0) THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken,
               (p.whole + CASE WHEN r.hash < coalesce(l.below, 0) THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
        LEFT JOIN limits l ON r.source IS NOT DISTINCT FROM l.source
    """,
    "op7_exact_top_k": """
        WITH points AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, p.vec_id,
                   list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM points q JOIN points p ON p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
    """,
    "op11_hard_negatives": """
        WITH points AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM points a JOIN points c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
            AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER best <= 3
    """,
}
