"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from loomlog.llm import bpe, decontamination, html_text, lm_score, minhash, phrases, pii, quality, sharding, simhash, spelling, token_counts, token_files


def queries() -> dict:
    return {"op1_token_counts": token_counts.op1_token_counts, "op2_byte_bpe": bpe.op2_byte_bpe, "op3_simhash": simhash.op3_simhash, "op4_token_files": token_files.op4_token_files, "op5_html_text": html_text.op5_html_text, "op6_lm_score": lm_score.op6_lm_score, "op7_decontamination": decontamination.op7_decontamination, "op8_sharding": sharding.op8_sharding, "op9_quality_rules": quality.op9_quality_rules, "op10_pii": pii.op10_pii, "op11_minhash": minhash.op11_minhash, "op12_spelling": spelling.op12_spelling, "op13_collocations": phrases.op13_collocations, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, CRC32, Luhn check, tokenizer or page parser; those queries are tested against brute force."""
    return {"op9_quality_rules": quality.ORACLE_SQL, "op11_minhash": minhash.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
