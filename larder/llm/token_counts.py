"""Token counts from an exact histogram of encoded lengths.

Every whole text is encoded once; (length, number of documents) is all that shuffles, summed on
the map side first. Suffix sums over the histogram then answer, for every context limit L, how many
documents and tokens there are in documents of at least L tokens, how many tokens remain when every
document is cut at L, and which quantile L is. The sums are two-level (blocks of lengths, then
lengths within a block), so no task gets the whole histogram, however many lengths occur.

Defined cases: null and empty texts have length 0 and count as documents; equal rows count each;
an empty table gives an empty histogram; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import small_batches, stored, texts_of
from larder.llm.tokens import default_vocabulary, encoder

#: Lengths per block of the two-level sums.
BLOCK = 256


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The encoded length of each whole text."""
    vocabulary = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) // 4 for t in texts_of(b)], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(count, "length long")


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length and n_docs, stored, since the answers read it more than once."""
    return stored(lengths(docs, vocabulary).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each occurring length, taken as context limit: the answers over the whole corpus."""
    block = F.floor(F.col("length") / BLOCK)
    tokens = F.col("n_docs") * F.col("length")
    blocks = hist.groupBy(block.alias("block")).agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # One row per block of lengths: as many as the longest text has blocks.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_later"),
    )
    totals = blocks.agg(F.sum("docs").alias("total_docs"), F.sum("tokens").alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    rows = (
        hist.withColumn("block", block)
        .withColumn("docs_here", F.sum("n_docs").over(within))
        .withColumn("tokens_here", F.sum(tokens).over(within))
        .join(later, F.col("block") == F.col("b"))
        .join(F.broadcast(totals))
    )
    docs_from = F.col("docs_here") + F.col("docs_later")
    tokens_from = F.col("tokens_here") + F.col("tokens_later")
    below = F.col("total_tokens") - tokens_from
    return rows.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (below + docs_from * F.col("length")).alias("truncated_total"),
        ((F.col("total_docs") - docs_from + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at limit, for a limit that need not occur."""
    return hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(limit))), F.lit(0)).alias("tokens"))


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of the documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))
