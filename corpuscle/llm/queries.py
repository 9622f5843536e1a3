"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.bpe import op10_byte_bpe
from corpuscle.llm.cotrain import op6_cotrain
from corpuscle.llm.line_dedup import op1_line_dedup
from corpuscle.llm import collocations, exact_topk, filter_audit, license_scan, mixing, setsketch_dedup
from corpuscle.llm.robust_outliers import op7_robust_outliers
from corpuscle.llm.simhash_dedup import op4_simhash_dedup
from corpuscle.llm.token_counts import op9_token_counts
from corpuscle.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_exact_topk": exact_topk.op5_exact_topk,
    "op6_cotrain": op6_cotrain,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_setsketch_dedup": setsketch_dedup.op12_setsketch_dedup,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE,
    "op5_exact_topk": exact_topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_setsketch_dedup": setsketch_dedup.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
