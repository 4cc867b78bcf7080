"""Ranks in groups of any size, without a window over a group.

Equal values share a rank, so only a group's different values need an order: they are counted (combined on the map
side), a group's values are cut into ranges at approximate quantiles, and a value's rank is the number of rows in the ranges
below plus that of smaller values in its own range. Windows run over the ranges of a group, a few hundred, and over the
values of one range. Split points need not be even: ranges only decide who counts what. Ranks are then joined to the
rows by group and value, both sides stored or read as they are, so that Spark can split a hot one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import storage

#: Ranges of a group, and different values up to which it has one.
RANGES, FEW = 200, 10_000
GROUP, VALUE = "larder_group", "larder_value"


def value_ranks(rows: DataFrame, group: str, measure: str, ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """larder_group, larder_value, rank (from 1, ascending, nulls last) and n_in_group of each different value of a group. Stored."""
    counts = storage.stored(rows.groupBy(F.col(group).alias(GROUP), F.col(measure).alias(VALUE)).agg(F.count("*").alias("n")), "counts")
    cuts = F.percentile_approx(VALUE, [i / ranges for i in range(1, ranges)], 100 * ranges)
    sizes = counts.groupBy(GROUP).agg(F.count("*").alias("values"), F.sum("n").alias("n_in_group"), cuts.alias("cuts"))
    sizes = sizes.select(F.col(GROUP).alias("g"), "n_in_group", F.when(F.col("values") > few, F.array_distinct("cuts")).otherwise(F.array().cast(counts.schema[VALUE].dataType.simpleString().join(["array<", ">"]))).alias("cuts"))
    # One row a group, stored: both sides are plain exchanges, or the small one is broadcast by its size.
    sizes = storage.stored(sizes, "groups")
    placed = counts.join(sizes, F.col(GROUP).eqNullSafe(F.col("g"))).drop("g")
    # The number of split points below a value; nulls come behind all.
    range_ = F.when(F.col(VALUE).isNull(), F.size("cuts") + 1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col(VALUE)))).alias("range")
    placed = storage.stored(placed.select(GROUP, VALUE, "n", "n_in_group", range_), "ranges")
    below = Window.partitionBy(GROUP).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    in_ranges = placed.groupBy(GROUP, "range").agg(F.sum("n").alias("m"))
    starts = in_ranges.select(F.col(GROUP).alias("g"), F.col("range").alias("r"), F.coalesce(F.sum("m").over(below), F.lit(0)).alias("start"))
    starts = storage.stored(starts, "starts")
    inside = Window.partitionBy(GROUP, "range").orderBy(F.col(VALUE).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = placed.withColumn("smaller", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = smaller.join(starts, F.col(GROUP).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    out = storage.stored(ranked.select(GROUP, VALUE, (F.col("start") + F.col("smaller") + 1).alias("rank"), "n_in_group"), "ranks")
    for t in (counts, sizes, placed, starts):
        storage.dropped(t)
    return out


def ranked(rows: DataFrame, group: str, measure: str, ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """rows with rank, n_in_group and percentile: 0 for the best, 100 for the last, null for a group of one row."""
    by_value = value_ranks(rows, group, measure, ranges, few)
    same = F.col(group).eqNullSafe(F.col(GROUP)) & F.col(measure).eqNullSafe(F.col(VALUE))
    percentile = F.round((F.col("rank") - 1) / F.nullif(F.col("n_in_group") - 1, F.lit(0)) * 100, 1)
    return rows.join(by_value, same).drop(GROUP, VALUE).withColumn("percentile", percentile)
