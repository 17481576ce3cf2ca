"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, jaccard, media, mixing, packing, pii, quality, sharding, substring_dedup, token_files

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality": quality.op2_quality,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_files": token_files.op6_token_files,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_pii": pii.op8_pii,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_media": media.op10_media,
    "sharding_small_limit": sharding.sharding_small_limit,
}

ORACLE_SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "sharding_small_limit": sharding.SMALL_LIMIT_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
