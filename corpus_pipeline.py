"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

1. quality classifier: rejected documents go;
2. line dedup: lines found in ten documents or more go from every document;
3. n-gram Jaccard join: one document of each group of near copies stays;
4. benchmark decontamination: contaminated documents go, others lose the words that benchmark windows hit;
5. SentencePiece codec: ids' and decoded texts' digests beside the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsewright.llm import decontaminate, line_dedup, ngram_join, piece_codec, quality_classifier
from sparsewright.llm.store import cut
from sparsewright.plans.session import shipped

STAGES = [
    ("quality_classifier", shipped(quality_classifier.stage)),
    ("line_dedup", shipped(line_dedup.stage)),
    ("ngram_join", shipped(ngram_join.stage)),
    ("decontaminate", shipped(decontaminate.stage)),
    ("piece_codec", shipped(piece_codec.stage)),
]

#: The first stage learns from labels, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
