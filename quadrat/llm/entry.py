"""Queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from quadrat.llm import bpe, chat, hard_negatives, language, licenses, near_dedup, packing, quality, ranked_search, simhash, tiff, top_k, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_language_id": language.op6_language_id,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_tiff_media": tiff.op9_tiff_media,
    "op10_exact_top_k": top_k.op10_exact_top_k,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op3_chat_format": chat.SQL,
    "op10_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_ranked_search": ranked_search.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
