"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, collocations, html, jaccard, licenses, media, mixing, packing, quality, spots, substrings, warc, whitening


def queries() -> dict:
    fs = [chat.op1_chat_formatting, licenses.op2_license_scans, media.op3_media_columns, html.op4_html_extraction, jaccard.op5_ngram_jaccard_join, substrings.op6_substring_dedup, mixing.op7_mixing, packing.op8_best_fit_packing, warc.op9_warc, quality.op10_quality_rules, spots.op11_document_fingerprints, collocations.op12_collocations, whitening.op13_whitening]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.OP1_SQL, "op5_ngram_jaccard_join": jaccard.OP5_SQL, "op6_substring_dedup": substrings.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op9_warc": warc.OP9_SQL, "op10_quality_rules": quality.OP10_SQL, "op12_collocations": collocations.OP12_SQL}
