"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import ann, bloom_lm, bpe, conv_trie, merkle, order_minhash, packing, pii, quality, secrets, simhash, slots, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_semi_markov_pii": pii.op1_semi_markov_pii,
    "op2_harmonic_packing": packing.op2_harmonic_packing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_importance_resampling": quality.op4_importance_resampling,
    "op5_adaptive_scan": ann.op5_adaptive_scan,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_secret_forest": secrets.op7_secret_forest,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_order_minhash": order_minhash.op9_order_minhash,
    "op10_bloom_lm": bloom_lm.op10_bloom_lm,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_virtual_slots": slots.op12_virtual_slots,
    "op13_conversation_trie": conv_trie.op13_conversation_trie,
}

SQL: dict[str, str] = {
    "op3_url_filter": url_filter.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_conversation_trie": conv_trie.SQL,
}
