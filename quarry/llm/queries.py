"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import bpe, decontaminate, embedding_dedup, html_text, license_scan, line_dedup, near_dedup, packing, sharding, source_divergence, token_files, toxicity, whitening

QUERIES = {
    "op1_embedding_links": embedding_dedup.op1_embedding_links,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_token_files": token_files.op4_token_files,
    "op5_bpe": bpe.op5_bpe,
    "op6_minhash": near_dedup.op6_minhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_whitening": whitening.op12_whitening,
    "op13_packing": packing.op13_packing,
}
ORACLE_SQL = {"op3_license_scan": license_scan.SQL, "op9_line_dedup": line_dedup.SQL, "op11_source_divergence": source_divergence.SQL}
