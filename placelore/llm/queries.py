"""The corpus queries by name, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from placelore.llm import op1_chat_formatting as op1
from placelore.llm import op5_ngram_jaccard as op5
from placelore.llm import op8_quality_cascade as op8
from placelore.llm import op9_substring_dedup as op9
from placelore.llm import op10_temperature_mixing as op10
from placelore.llm.op2_license_scan import op2_license_scan
from placelore.llm.op3_suffix_dedup import op3_suffix_dedup
from placelore.llm.op4_best_fit_packing import op4_best_fit_packing
from placelore.llm.op6_token_counts import op6_token_counts
from placelore.llm.op7_learned_partitions import op7_learned_partitions

QUERIES = {
    "op1_chat_formatting": op1.op1_chat_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard": op5.op5_ngram_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_quality_cascade": op8.op8_quality_cascade,
    "op9_substring_dedup": op9.op9_substring_dedup,
    "op10_temperature_mixing": op10.op10_temperature_mixing,
}

SQL = {
    "op1_chat_formatting": op1.SQL,
    "op5_ngram_jaccard": op5.SQL,
    "op8_quality_cascade": op8.SQL,
    "op9_substring_dedup": op9.SQL,
    "op10_temperature_mixing": op10.SQL,
}
