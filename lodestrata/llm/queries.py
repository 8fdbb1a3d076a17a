"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, forest_ann, line_dedup, mixing, near_dedup, packing, quality_pu, rule_cascade, sharding, toxicity_mil

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_prefix_forest": forest_ann.op1_hash_prefix_forest,
    "op2_pu_quality": quality_pu.op2_pu_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_stupid_backoff": backoff_lm.op4_stupid_backoff,
    "op5_temperature_mixing": mixing.op5_temperature_mixing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_rule_cascade": rule_cascade.op7_rule_cascade,
    "op8_virtual_slot_sharding": sharding.op8_virtual_slot_sharding,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_mil_toxicity": toxicity_mil.op10_mil_toxicity,
}

SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_temperature_mixing": mixing.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_rule_cascade": rule_cascade.OP7_SQL,
}
