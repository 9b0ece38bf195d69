"""Queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name and module; a module may hold ``sql()`` for its query.
_OPS = {
    "op8_range_coded_ids": "token_files",
    "op5_trie_counts": "token_counts",
    "op7_piece_codec": "piece_codec",
    "op10_importance_resampling": "resampling",
    "op2_chosen_path": "near_dup",
    "op1_maxscore": "maxscore",
    "op4_randomness_battery": "secret_scan",
    "op3_chat_events": "chat_events",
    "op6_cost_packing": "packing",
    "op9_quality_rules": "quality_rules",
    "op11_misra_gries_collocations": "collocations",
    "op12_cover_dedup": "repeats",
    "op13_merkle_manifest": "merkle",
}


def load() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name, module in _OPS.items():
        m = import_module(f"webtables.llm.{module}")
        queries[name] = getattr(m, name)
        if hasattr(m, "sql"):
            oracle[name] = m.sql()
    return queries, oracle
