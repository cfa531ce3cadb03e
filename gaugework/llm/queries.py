"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

import importlib

#: Module and query of each operator.
_MODULES = {
    "ngram_join": "op1_ngram_jaccard_join",
    "ann": "op2_nearest_neighbours",
    "secrets": "op3_secret_scan",
    "language": "op4_language_id",
    "byte_bpe": "op5_byte_bpe",
    "quality": "op6_quality_rules",
    "packing": "op7_packing",
    "chat": "op8_chat_format",
    "substring": "op9_substring_dedup",
    "line_dedup": "op10_line_dedup",
}


def queries() -> dict:
    found = {}
    for module, name in _MODULES.items():
        found[name] = getattr(importlib.import_module(f"gaugework.llm.{module}"), name)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in _MODULES.items():
        sql = getattr(importlib.import_module(f"gaugework.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
