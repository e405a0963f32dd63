"""The registered queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from tidewater.llm import chat_format, exact_dedup, html_extract, licenses, mixing, near_dedup, packing, quality, token_files, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLES = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
