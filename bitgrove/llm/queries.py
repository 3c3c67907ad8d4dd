"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, exact_dedup, html_extract, license_scan, mixing, pii, simhash, toxicity

QUERIES = {
    "op2_mixing": mixing.op2_mixing,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op9_html_extract": html_extract.op9_html_extract,
    "op3_chat_format": chat_format.op3_chat_format,
    "op5_pii": pii.op5_pii,
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_license_scan": license_scan.op10_license_scan,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
}

ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
