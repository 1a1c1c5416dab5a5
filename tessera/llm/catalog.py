"""Queries and SQL of this subpackage, by name."""

from . import decontaminate, html_text, langid, licenses, merkle, mixture, near_dedup, passages, quality, substrings, tokens, vectors, whitening

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_licenses": licenses.query,
    "op3_substrings": substrings.query,
    "op4_token_ids": tokens.query,
    "op5_mixture": mixture.query,
    "op6_decontaminate": decontaminate.query,
    "op7_vectors": vectors.query,
    "op8_html_text": html_text.query,
    "op9_passages": passages.query,
    "op10_quality": quality.query,
    "op11_merkle": merkle.query,
    "op12_whitening": whitening.query,
    "op13_langid": langid.query,
}
ORACLE_SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op3_substrings": substrings.SQL,
    "op5_mixture": mixture.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_vectors": vectors.SQL,
    "op9_passages": passages.SQL,
    "op11_merkle": merkle.SQL,
}
