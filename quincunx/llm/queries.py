"""The queries of this subpackage and their SQL, for registration by the entry module."""

from __future__ import annotations

from . import decontam, lines, media, pieces, pii, quality, simhash, substring, tokenstore, toxicity

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_toxicity": toxicity.query,
    "op3_substring_dedup": substring.query,
    "op4_token_store": tokenstore.query,
    "op5_pii": pii.query,
    "op6_simhash": simhash.query,
    "op7_decontamination": decontam.query,
    "op8_line_dedup": lines.query,
    "op9_sentencepiece": pieces.query,
    "op10_media": media.query,
}

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": substring.ORACLE_SQL}
