"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import (op1_substrings, op2_packing, op3_html, op4_near_dups, op5_topk, op6_quality,
               op7_token_counts, op8_lines, op9_mixing, op10_chat,
               op11_hard_negatives, op12_token_store, op13_phrases)

QUERIES = {
    "op1_substrings": op1_substrings.op1_substrings,
    "op2_packing": op2_packing.op2_packing,
    "op3_html": op3_html.op3_html,
    "op4_near_dups": op4_near_dups.op4_near_dups,
    "op5_topk": op5_topk.op5_topk,
    "op6_quality": op6_quality.op6_quality,
    "op7_token_counts": op7_token_counts.op7_token_counts,
    "op8_lines": op8_lines.op8_lines,
    "op9_mixing": op9_mixing.op9_mixing,
    "op10_chat": op10_chat.op10_chat,
    "op11_hard_negatives": op11_hard_negatives.op11_hard_negatives,
    "op12_token_store": op12_token_store.op12_token_store,
    "op13_phrases": op13_phrases.op13_phrases,
}

#: Tokenizers (2, 7, 12) and the HTML parser (3) have no SQL form.
ORACLE_SQL = {
    "op1_substrings": op1_substrings.SQL,
    "op4_near_dups": op4_near_dups.SQL,
    "op5_topk": op5_topk.SQL,
    "op6_quality": op6_quality.SQL,
    "op8_lines": op8_lines.SQL,
    "op9_mixing": op9_mixing.SQL,
    "op10_chat": op10_chat.SQL,
    "op11_hard_negatives": op11_hard_negatives.SQL,
    "op13_phrases": op13_phrases.SQL,
}
