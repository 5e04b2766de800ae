"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import op1_quality, op2_repeats, op3_urls, op4_packing, op5_media, op6_jaccard, op7_language, op8_pieces, op9_chat, op10_html, op11_private, op12_ranked, op13_align

QUERIES = {
    "op1_quality_rules": op1_quality.op1_quality_rules,
    "op2_suffix_dedup": op2_repeats.op2_suffix_dedup,
    "op3_url_filter": op3_urls.op3_url_filter,
    "op4_packing": op4_packing.op4_packing,
    "op5_media": op5_media.op5_media,
    "op6_jaccard_join": op6_jaccard.op6_jaccard_join,
    "op7_language_id": op7_language.op7_language_id,
    "op8_sentencepiece": op8_pieces.op8_sentencepiece,
    "op9_chat_format": op9_chat.op9_chat_format,
    "op10_main_text": op10_html.op10_main_text,
    "op11_private": op11_private.op11_private,
    "op12_ranked_search": op12_ranked.op12_ranked_search,
    "op13_alignment": op13_align.op13_alignment,
}

#: The others can't be expressed in SQL; tests hold them against brute force.
ORACLES = {
    "op1_quality_rules": op1_quality.SQL,
    "op3_url_filter": op3_urls.SQL,
    "op9_chat_format": op9_chat.SQL,
    "op11_private": op11_private.SQL,
    "op12_ranked_search": op12_ranked.SQL,
}
