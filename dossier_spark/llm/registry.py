"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_html_text": "html_text",
    "op2_progressive_jpeg": "jpeg",
    "op3_byte_bpe": "bpe",
    "op4_hnsw": "hnsw",
    "op5_source_mixing": "mixing",
    "op6_near_dedup": "near_dedup",
    "op7_language_id": "language_id",
    "op8_substring_dedup": "substring_dedup",
    "op9_toxicity": "toxicity",
    "op10_warc": "warc",
    "op11_collocations": "collocations",
    "op12_prefix_trie": "prefix_trie",
    "op13_suffix_dedup": "suffix_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = [importlib.import_module(f"{__package__}.{m}") for m in MODULES.values()]
    return {k: v for m in modules for k, v in getattr(m, "ORACLE_SQL", {}).items()}
