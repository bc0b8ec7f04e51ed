"""Corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``documents``; the last returns the pieces of the packed sequences. An empty table passes
through all stages. How a stage treats nulls, ties and repeated rows is stated by its operator;
rows without an id are kept by the first three stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.llm import mixing, near_duplicates, packing, quality, secrets
from runstore.llm.queries import WEIGHTS, levels
from runstore.llm.workspace import Workspace

#: Share of the words that reach the mixing stage which it is to keep.
MIX_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Rows that repeat an id stay or go together, by the one with the smallest text.
    """
    found = near_duplicates.near_duplicates(docs)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights, none twice."""
    mix = mixing.fresh_name("_mix", docs.columns)
    return mixing.mix_sources(docs, levels(), WEIGHTS, budget=MIX_SHARE, seed=9, as_col=mix).drop(mix)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express the trained models, sketches and tokens; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    ws, docs = Workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else ws.cut(docs, free_shuffles=True)
    return docs
