"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .audit import op13_filter_audit
from .bpe import op9_byte_bpe
from .decontaminate import op1_decontaminate
from .embeddings import op2_itq_embeddings
from .html import op3_html_text
from .language import op7_language
from .linededup import op8_line_dedup
from .merkle import op12_merkle_manifest
from .minhash import op10_superminhash
from .pii import op6_pii
from .tokencount import op11_token_counts
from .toxicity import op4_toxicity
from .urls import op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_superminhash": op10_superminhash,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
    "op1_decontaminate": op1_decontaminate,
    "op2_itq_embeddings": op2_itq_embeddings,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_line_dedup": op8_line_dedup,
    "op9_byte_bpe": op9_byte_bpe,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
