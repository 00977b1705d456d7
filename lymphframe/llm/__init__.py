"""Corpus operators for training-data pipelines: thirteen methods over documents, pages and embeddings."""

from __future__ import annotations

from lymphframe.llm import filter_audit, merkle, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter


def queries() -> dict:
    found = (
        sentencepiece_codec.op1_sentencepiece,
        simhash.op2_simhash_near_dedup,
        suffix_dedup.op3_suffix_array_dedup,
        toxicity.op4_toxicity,
        packing.op5_best_fit_packing,
        quality_rules.op6_quality_rules,
        pii.op7_pii,
        token_counts.op8_token_counts,
        quality_classifier.op9_quality_classifier,
        topk.op10_exact_top_k,
        filter_audit.op11_filter_audit,
        url_filter.op12_url_filter,
        merkle.op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_top_k": topk.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_url_filter": url_filter.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
