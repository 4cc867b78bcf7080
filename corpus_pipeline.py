"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, written as Parquet and read again, and returns it in
the columns of documents, but for the last, which returns pieces of sequences. A stage's table goes when the next one's is written.

Defined cases: null and empty texts have quality 0 and go in the first stage, so later ones see texts with words only; of rows that
share text and doc_id one stays (exact), of texts that differ in capitals only the one with the largest doc_id; of near copies
the smallest doc_id stays, and rows without a doc_id are neither near copies of others nor dropped for them; mixing repeats
rows, so pieces of one document can lie in several sequences; texts of any length are read whole; extra columns ride along to the
last stage, which returns its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import exact_dedup, mixing, near_dedup, packing, quality
from larder.llm.common import dropped, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at similarity 0.80, the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs, near_dedup.STAGE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are weighted by the square root of their size; a document occurs as often as it is drawn."""
    return mixing.remixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The scorer, the near-duplicate components and the genetic packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    # The last stage has stored its pieces.
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    dropped(docs)
    return pieces
