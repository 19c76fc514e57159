"""The registered queries of this subpackage."""

from __future__ import annotations

import importlib

import corpus_pipeline

OPERATORS = {
    "op11_hard_negatives": "hard_negatives",
    "op12_language_id": "lang_id",
    "op13_conversation_repair": "conversation_repair",
    "op9_html_extraction": "html_extract",
    "op2_benchmark_decontamination": "decontaminate",
    "op5_url_filters": "url_filter",
    "op6_chat_formatting": "chat",
    "op8_warc": "warc",
    "op3_pii": "pii",
    "op4_ngram_jaccard_join": "ngram_join",
    "op7_quality_rules": "quality",
    "op10_bpe": "bpe",
    "op1_substring_dedup": "substring_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lodestrata.llm.{module}"), name) for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"lodestrata.llm.{module}") for name, module in OPERATORS.items()}
    return {name: module.ORACLE_SQL for name, module in modules.items() if getattr(module, "ORACLE_SQL", None)}
