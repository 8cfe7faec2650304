"""The corpus pipeline: toxicity, language identification, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes to the shared folder and reads again as the next stage's docs. All
stages but the last return the columns of ``documents``; the last returns the
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, jaccard, langid, packing, shared, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", langid.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the trained stages nor the packing; tests/llm/test_tables.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
