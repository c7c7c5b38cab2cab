"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_url_filters": "url_filter",
    "op2_line_dedup": "line_dedup",
    "op3_lm_score": "lm_score",
    "op4_chat_format": "chat_format",
    "op5_quality_rules": "quality_rules",
    "op6_mixing": "mixing",
    "op7_token_files": "token_files",
    "op8_license_scan": "license_scan",
    "op9_jaccard_join": "jaccard_join",
    "op10_decontaminate": "decontaminate",
    "op11_run_index": "run_index",
    "op12_importance": "importance",
    "op13_periodic_runs": "periodic_runs",
}


def queries() -> dict:
    return {name: getattr(import_module(f"tidemark.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidemark.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
