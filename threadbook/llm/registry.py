"""Queries and SQL of the training-data operators: one opN_<name> each, and parts of them that SQL can say where it cannot say the whole."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_exact_topk", "op2_suffix_dedup", "op3_secret_scan", "op4_ngram_join", "op5_quality", "op6_warc", "op7_decontaminate", "op8_source_mix", "op9_substring_dedup", "op10_token_rollups", "op11_hard_negatives", "op12_collocations", "op13_bpe_codec"]

QUERIES = {}
ORACLE_SQL = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    _found = {_name: (getattr(_module, _name), _module.SQL)} | getattr(_module, "EXTRA", {})
    QUERIES |= {n: f for n, (f, _) in _found.items()}
    ORACLE_SQL |= {n: sql for n, (_, sql) in _found.items() if sql}
