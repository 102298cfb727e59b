"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladespark.llm import byte_cnn, lm_scoring, ngram_join, packing, personal_data, quality_rules, secrets_scan, sharding, source_mixing, transport_stream
from cladespark.llm.oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_transport_stream": transport_stream.op1_transport_stream,
        "op2_byte_cnn": byte_cnn.op2_byte_cnn,
        "op3_stupid_backoff": lm_scoring.op3_stupid_backoff,
        "op4_concat_and_cut": packing.op4_concat_and_cut,
        "op5_pareto_mix": source_mixing.op5_pareto_mix,
        "op6_lsh_forest": ngram_join.op6_lsh_forest,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_secret_scan": secrets_scan.op8_secret_scan,
        "op9_bootstrapped_pii": personal_data.op9_bootstrapped_pii,
        "op10_jump_hash": sharding.op10_jump_hash,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
