"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import counts, decontam, exact, lines, merkle, neardup, packing, pii, repair, simhash, substrings, toxicity, warc
from textloom.storage import bound_batches

_OPERATORS = {
    "op1_line_dedup": lines.query,
    "op2_minhash_neardup": neardup.query,
    "op3_packing": packing.query,
    "op4_warc": warc.query,
    "op5_decontamination": decontam.query,
    "op6_pii": pii.query,
    "op7_exact_dedup": exact.query,
    "op8_substring_dedup": substrings.query,
    "op9_toxicity": toxicity.query,
    "op10_token_counts": counts.query,
    "op11_structure_repair": repair.query,
    "op12_simhash_neardup": simhash.query,
    "op13_merkle_manifest": merkle.query,
    # What op5's index finds besides exact passages.
    "proximity_matches": decontam.proximity_query,
}


def _entry(operator: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return operator(spark, sf_dir)

    return run


QUERIES = {name: _entry(operator) for name, operator in _OPERATORS.items()}
ORACLES = {
    "op2_minhash_neardup": neardup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op7_exact_dedup": exact.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
}
