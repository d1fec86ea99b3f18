"""A training-corpus pipeline: each stage works on all that the stage before it kept.

Texts go in and token ids come out: robust quality rules, one document of each group of near copies, benchmark
decontamination, replacement of personal data, and byte-level BPE. Stages return the columns of ``documents``, the last
one token ids in place of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, pii, quality, set_join
from lodestone.llm.shared import stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", set_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("personal data", pii.stage),
    ("byte-level BPE", bpe.stage),
]

#: Robust distances, components and merges have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
