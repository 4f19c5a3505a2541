"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_packing": "packing",
    "op2_licenses": "licenses",
    "op3_mixing": "mixing",
    "op4_secrets": "secrets",
    "op5_vector_dedup": "vector_dedup",
    "op6_line_dedup": "line_dedup",
    "op7_toxicity": "toxicity",
    "op8_language_id": "language_id",
    "op9_vector_search": "vector_search",
    "op10_minhash_dedup": "minhash_dedup",
    "op11_infill": "infill",
    "op12_phrases": "phrases",
    "op13_quality": "quality",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"nubla.llm.{module}"), name) for name, module in NAMES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in NAMES.items() if (sql := getattr(import_module(f"nubla.llm.{module}"), "ORACLE_SQL", None))}
