"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op13_distinct_word_bpe
from .decontaminate import op6_decontamination
from .html import op1_html_lstm
from .licenses import op5_license_scan
from .lines import OP8_SQL, op8_line_dedup
from .negatives import OP12_SQL, op12_pca_negatives
from .neardup import op10_minhash_hamming
from .packing import op2_hilbert_packing
from .pii import op7_pii_spans
from .quality import op4_quality_rules
from .secrets import op9_secret_spans
from .substrings import op3_suffix_dedup
from .whitening import op11_two_pass_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_lstm": op1_html_lstm,
    "op2_hilbert_packing": op2_hilbert_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_pii_spans": op7_pii_spans,
    "op8_line_dedup": op8_line_dedup,
    "op9_secret_spans": op9_secret_spans,
    "op10_minhash_hamming": op10_minhash_hamming,
    "op11_two_pass_whitening": op11_two_pass_whitening,
    "op12_pca_negatives": op12_pca_negatives,
    "op13_distinct_word_bpe": op13_distinct_word_bpe,
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op12_pca_negatives": OP12_SQL}
