"""The registered queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import importlib

#: Name of a query: module of this subpackage that has its ``query``.
MODULES = {
    "op1_template_decontamination": "decontaminate",
    "op2_pretoken_counts": "token_counts",
    "op3_jpeg_media": "jpeg",
    "op4_hyperdimensional_langid": "language_id",
    "op5_lyndon_suffix_groups": "suffix_dedup",
    "op6_gumbel_segmentations": "sample_encode",
    "op7_byte_prefix_shards": "sharding",
    "op8_pii_checksums": "pii",
    "op9_super_minhash": "minhash",
    "op10_line_bitmaps": "line_dedup",
    "op11_balanced_postings": "vector_search",
    "op12_deepening_repair": "turn_repair",
    "op13_pipelined_search": "lexical_search",
}


def queries():
    return {name: importlib.import_module(f"hustings.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql():
    found = {name: getattr(importlib.import_module(f"hustings.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
