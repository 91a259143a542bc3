"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op4_benchmark_decontamination
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op2_html_extraction
from .jaccard_join import op1_ngram_jaccard_join
from .language import op7_language_id
from .license_scan import OP3_SQL, op3_license_scan
from .periodic_runs import op12_periodic_runs
from .pieces import op5_sentencepiece
from .quality import op6_quality_classifier
from .sharding import OP9_SQL, op9_sharding
from .suffix_dedup import op10_suffix_array_dedup
from .toxicity import op13_toxicity
from .vector_dedup import op8_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op9_sharding": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
}
