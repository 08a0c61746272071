"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_language_id, op2_shard, op3_url_filter, op4_substring_dedup, op5_embedding_dedup, op6_minhash_dedup, op7_sentencepiece, op8_pack, op9_nearest, op10_token_files

QUERIES = {
    "op1_language_id": op1_language_id.query,
    "op2_shard": op2_shard.query,
    "op3_url_filter": op3_url_filter.query,
    "op4_substring_dedup": op4_substring_dedup.query,
    "op5_embedding_dedup": op5_embedding_dedup.query,
    "op6_minhash_dedup": op6_minhash_dedup.query,
    "op7_sentencepiece": op7_sentencepiece.query,
    "op8_pack": op8_pack.query,
    "op9_nearest": op9_nearest.query,
    "op10_token_files": op10_token_files.query,
}

ORACLES = {
    "op3_url_filter": op3_url_filter.ORACLE,
    "op4_substring_dedup": op4_substring_dedup.ORACLE,
    "op5_embedding_dedup": op5_embedding_dedup.ORACLE,
    "op6_minhash_dedup": op6_minhash_dedup.ORACLE,
}
