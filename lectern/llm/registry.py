"""Queries of this subpackage and the SQL that gives the same rows where SQL can."""

from lectern.llm import bpe, fill_middle, fingerprints, hamming, html_extraction, language, mixing, simhash, spelling, suffixes, token_counts, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_html_extraction": html_extraction.query,
    "op3_source_mixing": mixing.query,
    "mix_targets": mixing.targets_query,
    "op4_document_fingerprints": fingerprints.query,
    "op5_suffix_dedup": suffixes.query,
    "op6_byte_bpe": bpe.query,
    "op7_url_filter": url_filter.query,
    "op8_simhash": simhash.query,
    "op9_topk_search": hamming.query,
    "op10_language_id": language.query,
    "op11_spelling_variants": spelling.query,
    "op12_toxicity": toxicity.query,
    "op13_fill_in_middle": fill_middle.query,
}

ORACLES: dict[str, str] = {"op9_topk_search": hamming.ORACLE, "op13_fill_in_middle": fill_middle.ORACLE, "mix_targets": mixing.TARGETS_ORACLE}
