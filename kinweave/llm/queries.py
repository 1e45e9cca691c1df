"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import language, media, mixing, pieces, quality, simhash, substrings, suffixes, toxicity, warc

QUERIES = {
    "op1_media_sniff": media.op1_media_sniff,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc_convert": warc.op9_warc_convert,
    "op10_mix_curriculum": mixing.op10_mix_curriculum,
}

ORACLES = {
    "op7_quality_rules": quality.OP7_SQL,
    "op9_warc_convert": warc.OP9_SQL,
    "op10_mix_curriculum": mixing.OP10_SQL,
}
