"""Registry of the corpus operators: name to query, and name to oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, language, licences, lines, mixing, neardup, passages, quality, sharding, suffixes

QUERIES = {
    "op1_temperature_mix": mixing.op1_temperature_mix,
    "op2_template_decontamination": decontamination.op2_template_decontamination,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_minhash_chosen_path": neardup.op4_minhash_chosen_path,
    "op5_compact_windows": passages.op5_compact_windows,
    "op6_shard_bytes": sharding.op6_shard_bytes,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_suffix_arrays": suffixes.op8_suffix_arrays,
    "op9_fuzzy_lines": lines.op9_fuzzy_lines,
    "op10_language_id": language.op10_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_minhash_chosen_path": neardup.OP4_SQL,
    "op7_quality_rules": quality.OP7_SQL,
}
