"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import embedding_dedup, importance, language_id, line_dedup, minhash_dedup, oracles, packing, periodic_runs, pii, quality_rules, sentencepiece_codec, substring_dedup, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup.op1,
    "op2_language_id": language_id.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_pii": pii.op4,
    "op5_sentencepiece": sentencepiece_codec.op5,
    "op6_packing": packing.op6,
    "op7_minhash_dedup": minhash_dedup.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_token_counts": tokens.op9,
    "op10_toxicity": toxicity.op10,
    "op11_importance_resampling": importance.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_substring_dedup": substring_dedup.op13,
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": line_dedup.OP8_SQL, "op11_importance_resampling": oracles.OP11_SQL, "op12_periodic_runs": oracles.OP12_SQL, "op13_substring_dedup": oracles.OP13_SQL}
