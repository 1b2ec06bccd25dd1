"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from slotloom.llm import decontaminate, exact_dedup, html_extract, merkle, mixing, near_dedup, periodic_runs, pii, substring_dedup, suffix_dedup, token_files, toxicity, url_filter


QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_pii": pii.op9_pii,
    "op10_token_files": token_files.op10_token_files,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
