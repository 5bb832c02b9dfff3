"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import hosts, mixing, phrases, quality, repeats, sentence_pieces, simhash, token_counts, token_files, toxicity

QUERIES: dict[str, Callable] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_url_filters": hosts.op3_url_filters,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_files": token_files.op6_token_files,
    "op7_suffix_array_dedup": repeats.op7_suffix_array_dedup,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprints": phrases.op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op3_url_filters": hosts.ORACLE_SQL}
