"""The corpus pipeline: raw documents to token files, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm.classifier import classify_stage
from litsieve.llm.decontaminate import decontaminate_stage
from litsieve.llm.mixing import mix_stage
from litsieve.llm.sketch_join import dedup_stage
from litsieve.llm.tokens import tokens_stage
from litsieve.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("source_mix", mix_stage),
    ("token_files", tokens_stage),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
