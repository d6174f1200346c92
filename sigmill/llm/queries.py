"""The registered query of each operator of this folder, and SQL twins where SQL can say it."""

from __future__ import annotations

from .align import op11_cross_tokenizer_alignment
from .chat import OP5_SQL, op5_chat_formatting
from .decontaminate import op6_benchmark_decontamination
from .fingerprint import op9_document_fingerprints
from .lm import op1_ppm_scoring
from .near import op8_minhash_near_dedup
from .packing import op7_best_fit_packing
from .pii import op4_personal_data
from .quality import op10_quality_classifier
from .quantized import op12_embedding_near_dedup
from .secrets import op2_secret_scans
from .substrings import op3_substring_dedup
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_ppm_scoring": op1_ppm_scoring,
    "op2_secret_scans": op2_secret_scans,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {"op5_chat_formatting": OP5_SQL}
