"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, language_id, line_dedup, mixing, near_dedup, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_order_minhash": fingerprints.op4_order_minhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_token_files": token_files.op7_token_files,
    "op8_simhash": near_dedup.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLES = exact_dedup.ORACLE | line_dedup.ORACLE | substring_dedup.ORACLE | url_filter.ORACLE
