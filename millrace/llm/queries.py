"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import op9_byte_bpe
from millrace.llm.fingerprints import op8_fingerprints
from millrace.llm.jaccard_join import op4_jaccard_join
from millrace.llm.license_scan import op5_license_scan
from millrace.llm.lm_scoring import op7_lm_scoring
from millrace.llm.packing import op10_packing
from millrace.llm.quality_lm import op6_quality_classifier
from millrace.llm.quality_rules import op1_quality_rules
from millrace.llm.secret_scan import op3_secret_scan
from millrace.llm.sql import oracle_sql
from millrace.llm.toxicity import op2_toxicity

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_toxicity, op3_secret_scan, op4_jaccard_join, op5_license_scan, op6_quality_classifier, op7_lm_scoring, op8_fingerprints, op9_byte_bpe, op10_packing]
    return {f.__name__: f for f in found}
