"""Exact distinct counts for any set of runs, from stored bitmaps.

Every value of a column gets a number from a dictionary, dense from 0. A run's values are a bitmap over these numbers, cut into
segments of 32768 bits; the bitmaps of several runs are or-ed and their bits counted, without reading products again. A
dictionary's numbers are given in buckets of values' hashes: windows run over a bucket, whose number is chosen by a
count, and a bucket's first number is the sum of those before, so no task holds all values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import storage

#: Values that one task of the dictionary puts in order.
BUCKET_VALUES = 1_000_000


def _pairs(rows: DataFrame, columns: Mapping[str, str], run: str) -> DataFrame:
    """A run's different values, by column."""
    values = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for c, name in columns.items()])
    return rows.select(F.col(run).alias("run"), F.inline(values)).filter("value IS NOT NULL").distinct()


def dictionary(pairs: DataFrame, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """name, value and number, dense from 0 for each name."""
    values = storage.stored(pairs.select("name", "value").distinct(), "values")
    buckets = -(-values.count() // bucket_values) or 1
    placed = values.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("name", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("name").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_bucket = F.row_number().over(Window.partitionBy("name", "bucket").orderBy("value"))
    numbered = placed.withColumn("place", in_bucket).join(starts, (F.col("name") == F.col("of")) & (F.col("bucket") == F.col("b")))
    out = storage.stored(numbered.select("name", "value", (F.col("start") + F.col("place") - 1).alias("number")), "dictionary")
    storage.dropped(values)
    return out


def run_bitmaps(rows: DataFrame, columns: Mapping[str, str], run: str = "ingest_run_id", bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """run, name, segment and bits of every run and column (columns: column -> name). Stored."""
    pairs = storage.stored(_pairs(rows, columns, run), "pairs")
    numbers = dictionary(pairs, bucket_values).withColumnsRenamed({"name": "of", "value": "v"})
    found = pairs.join(numbers, (F.col("name") == F.col("of")) & (F.col("value") == F.col("v")))
    # The functions number positions from 1.
    place = F.col("number") + 1
    bits = found.groupBy("run", "name", F.bitmap_bucket_number(place).alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = storage.stored(bits, "bitmaps")
    storage.dropped(pairs)
    storage.dropped(numbers)
    return out


def counted(bitmaps: DataFrame, names: Iterable[str], *by: Column) -> DataFrame:
    """The number of different values of each column, by some expressions of run: bitmaps are or-ed, then counted."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(by)]
    whole = bitmaps.groupBy(*keys, "name", "segment").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(f"unique_{n}") for n in names]
    return whole.groupBy(*[f"k{i}" for i in range(len(by))]).agg(*sums)
