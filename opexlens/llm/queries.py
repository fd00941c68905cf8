"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from opexlens.llm import (conversations, decontaminate, html_text, jaccard, lines, mixing, packing, quality, search, sharding, sketches, substrings,
                          toxicity)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_near_duplicates": jaccard.op4_near_duplicates,
    "op5_quality": quality.op5_quality,
    "op6_substrings": substrings.op6_substrings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lines": lines.op8_lines,
    "op9_html": html_text.op9_html,
    "op10_fingerprints": sketches.op10_fingerprints,
    "op11_contamination": decontaminate.op11_contamination,
    "op12_search": search.op12_search,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE: dict[str, str] = {
    "op4_near_duplicates": jaccard.OP4_SQL,
    "op5_quality": quality.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op8_lines": lines.OP8_SQL,
    "op11_contamination": decontaminate.OP11_SQL,
    "op12_search": search.OP12_SQL,
}
