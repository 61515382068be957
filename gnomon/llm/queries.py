"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, fingerprints, mixing, near_dedup, sharding, substring_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_sharding": sharding.op2_sharding,
    "op3_document_fingerprints": fingerprints.op3_document_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_chat_formatting": chat_format.op10_chat_formatting,
}

#: DuckDB SQL for the queries that SQL can express.
SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_document_fingerprints": fingerprints.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_chat_formatting": chat_format.OP10_SQL,
}
