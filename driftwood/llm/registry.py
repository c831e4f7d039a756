"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from driftwood.llm import dac, language_id, line_dedup, merge_dropout, near_dup, packing, quality_rules, secret_scan, separators, vector_search

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_kmeans_tree": vector_search.op2_kmeans_tree,
    "op3_separator_scan": separators.op3_separator_scan,
    "op4_packing": packing.op4_packing,
    "op5_decision_list": quality_rules.op5_decision_list,
    "op6_merge_dropout": merge_dropout.op6_merge_dropout,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_bbit_minhash": near_dup.op8_bbit_minhash,
    "op9_language_id": language_id.op9_language_id,
    "op10_dac": dac.op10_dac,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op8_bbit_minhash": near_dup.ORACLE_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
