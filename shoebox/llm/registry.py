"""The queries of the text operators and their SQL."""

from __future__ import annotations

from shoebox.llm import bpe, decontam, fingerprint, htmltext, langid, linededup, merkle, quality, simhash, tokencount, toxicity, urlrules, vectorcodes

QUERIES = {
    "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
    "op2_html_extraction": htmltext.op2_html_extraction,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filters": urlrules.op9_url_filters,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality": quality.op12_quality,
    "op13_vector_codes": vectorcodes.op13_vector_codes,
}
ORACLE = {
    "op4_decontamination": decontam.ORACLE,
    "op9_url_filters": urlrules.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_vector_codes": vectorcodes.ORACLE,
}
