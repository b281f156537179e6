"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import ann, chat, licenses, media, mixing, neardup, packing, sitetree, suffixes, toxicity

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_minhash_near_dedup": neardup.op2_minhash_near_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_html_extraction": sitetree.op4_html_extraction,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_tiff_media": media.op6_tiff_media,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_graph_neighbours": ann.op10_graph_neighbours,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op3_license_scan": licenses.ORACLE, "op8_mix_sources": mixing.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
