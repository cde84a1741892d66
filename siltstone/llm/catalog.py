"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from siltstone.llm import chat_format, decontaminate, lexical_search, license_scan, near_dedup, pieces, quality, sharding, suffix_dedup, time_layout, toxicity, vector_dedup, window_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_license_scan": license_scan.query,
    "op3_quality_classifier": quality.query,
    "op4_substring_dedup": window_dedup.query,
    "op5_minhash_dedup": near_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_embedding_dedup": vector_dedup.query,
    "op8_chat_format": chat_format.query,
    "op9_decontamination": decontaminate.query,
    "op10_sentencepiece": pieces.query,
    "op11_time_partitions": time_layout.query,
    "op12_histogram_shards": sharding.query,
    "op13_lexical_search": lexical_search.query,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.oracle(),
    "op2_license_scan": license_scan.oracle(),
    "op4_substring_dedup": window_dedup.oracle(),
    "op5_minhash_dedup": near_dedup.oracle(),
    "op7_embedding_dedup": vector_dedup.oracle(),
    "op8_chat_format": chat_format.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
