"""Corpus pipeline: quality rules, near duplicates, repeated passages, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result and reads it
again as the next stage's documents.
"""

from __future__ import annotations

from gatewarden.llm.shared import Scratch, table
from gatewarden.llm.stages import mix, near_duplicates, pack, passages, quality

STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", passages),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: Exact near-duplicate components, byte-level passages and token ids are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
