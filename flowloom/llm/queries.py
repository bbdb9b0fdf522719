"""The training-data queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import OP11_SQL, op11_conversation_repair
from .embedding_dedup import OP3_SQL, op3_embedding_near_dedup
from .language_id import op4_language_id
from .licenses import op5_license_scan
from .minhash_dedup import OP2_SQL, op2_minhash_near_dedup
from .packing import op6_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .pii import op10_pii
from .quality_model import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .sentencepiece import op7_sentencepiece
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op12_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_minhash_near_dedup": OP2_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op11_conversation_repair": OP11_SQL,
}
