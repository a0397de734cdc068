"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from techtrail.llm import centroids, html_main_text, language_ppm, packing, quality_rules, secrets, sentence_spans, simhash, spelling, telephony, toxicity, warc_archive, word_bpe

QUERIES = {
    "op1_telephony_media": telephony.op1_telephony_media,
    "op2_sentence_spans": sentence_spans.op2_sentence_spans,
    "op3_simhash_pivots": simhash.op3_simhash_pivots,
    "op4_adaptive_quality": quality_rules.op4_adaptive_quality,
    "op5_language_ppm": language_ppm.op5_language_ppm,
    "op6_html_tree_scoring": html_main_text.op6_html_tree_scoring,
    "op7_toxicity_trees": toxicity.op7_toxicity_trees,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_secret_novelty": secrets.op9_secret_novelty,
    "op10_word_bpe": word_bpe.op10_word_bpe,
    "op11_subvector_centroids": centroids.op11_subvector_centroids,
    "op12_spelling_tiles": spelling.op12_spelling_tiles,
    "op13_warc_members": warc_archive.op13_warc_members,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op4_adaptive_quality": quality_rules.ORACLE_SQL,
    "op11_subvector_centroids": centroids.ORACLE_SQL,
    "op12_spelling_tiles": spelling.ORACLE_SQL,
    "op13_warc_members": warc_archive.ORACLE_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
