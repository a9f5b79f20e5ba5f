"""The corpus pipeline: five operators in turn over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Between stages the rows are written and
read again, so a lost executor never sends the work back beyond a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._store import materialize
from gristmill.llm.jaccard import keep_one
from gristmill.llm.mixing import mix
from gristmill.llm.packing import pack
from gristmill.llm.quality import keep_good
from gristmill.llm.substring import dedup_substrings

#: The stages hash, tile, mix and tokenize by methods that SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere before; n_chars follows the text."""
    clean = dedup_substrings(docs).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, a row for each copy."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.

    Rows without a text or without words go in the first stage; null and equal
    keys are rows of their own in all stages; an empty table gives no pieces.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = materialize(rows, f"stage{k + 1}")
    return rows
