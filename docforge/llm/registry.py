"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, contamination, lines, minhash, mixing, negatives, neighbours, pitman_yor, quality, rules, secrets, suffixes, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        neighbours.op1_nearest_neighbours,
        quality.op2_quality_classifier,
        tokens.op3_token_counts,
        lines.op4_line_dedup,
        pitman_yor.op5_language_model,
        minhash.op6_near_duplicates,
        secrets.op7_secret_scan,
        mixing.op8_mix_sources,
        contamination.op9_decontamination,
        suffixes.op10_suffix_dedup,
        negatives.op11_hard_negatives,
        rules.op12_quality_rules,
        alignment.op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": lines.OP4_SQL, "op6_near_duplicates": minhash.OP6_SQL, "op9_decontamination": contamination.OP9_SQL, "op8_mix_sources": mixing.OP8_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_quality_rules": rules.OP12_SQL}
