"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import (
    conversations, exact_dedup, kneser_ney, line_dedup, packing, quality, secret_scan, simhash_dedup, spelling, token_counts,
    topk, toxicity, unigram,
)
from .common import table

QUERIES = {
    "op1_quality": lambda spark, d: quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents"), keep="largest"),
    "op10_simhash_dedup": lambda spark, d: simhash_dedup.near_duplicates(table(spark, d, "documents")),
    "op3_topk": lambda spark, d: topk.every_fiftieth(table(spark, d, "embeddings")),
    "op4_kneser_ney": lambda spark, d: kneser_ney.score_held_out(table(spark, d, "documents")),
    "op5_line_dedup": lambda spark, d: line_dedup.line_report(table(spark, d, "documents"), limit=None),
    "op6_toxicity": lambda spark, d: toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_unigram": lambda spark, d: unigram.encode_and_check(table(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op9_secret_scan": lambda spark, d: secret_scan.scan_all(spark, table(spark, d, "documents")),
    "op11_conversation_repair": lambda spark, d: conversations.repair_damaged(table(spark, d, "conversations")),
    "op12_token_counts": lambda spark, d: token_counts.count_tokens(table(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: spelling.variants_of(table(spark, d, "documents")),
}

ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
}
