"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from spanloom.llm import bpe, centroids, chat, html_main, langid, minhash, mixing, neardup_vectors, quality_rules, sharding, token_counts, topk, upsert


def queries():
    """Query by name; each takes (spark, sf_dir)."""
    return {
        "op1_tokens": token_counts.op1_tokens,
        "op2_minhash": minhash.op2_minhash,
        "op3_chat": chat.op3_chat,
        "op4_html": html_main.op4_html,
        "op5_langid": langid.op5_langid,
        "op6_bpe": bpe.op6_bpe,
        "op7_topk": topk.op7_topk,
        "op8_mix": mixing.op8_mix,
        "op9_neardup_vectors": neardup_vectors.op9_neardup_vectors,
        "op10_shard": sharding.op10_shard,
        "op11_quality": quality_rules.op11_quality,
        "op12_upsert": upsert.op12_upsert,
        "op13_centroids": centroids.op13_centroids,
        "mix_targets": mixing.mix_targets,
    }


def oracle_sql():
    """DuckDB SQL for the queries that SQL can express."""
    return {"op3_chat": chat.ORACLE, "op7_topk": topk.ORACLE, "op9_neardup_vectors": neardup_vectors.ORACLE, "op13_centroids": centroids.ORACLE, "mix_targets": mixing.TARGETS}
