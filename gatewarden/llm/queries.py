"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import ORACLE_OP10, op10_chat_formatting
from .fingerprints import op4_fingerprints
from .html_text import op6_html_extraction
from .mixing import op2_mix_sources
from .ngram_join import op7_ngram_jaccard_join
from .packing import op8_pack_sequences
from .quality import ORACLE_ABLATIONS, ORACLE_OP9, op9_quality_rules, quality_ablations
from .substring_dedup import op5_suffix_array_dedup
from .token_files import op3_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_counts": op3_token_counts,
    "op4_fingerprints": op4_fingerprints,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "quality_ablations": quality_ablations,
}

ORACLES = {
    "op9_quality_rules": ORACLE_OP9,
    "op10_chat_formatting": ORACLE_OP10,
    "quality_ablations": ORACLE_ABLATIONS,
}
