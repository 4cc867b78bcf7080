"""Data-quality gates: each returns the rows that violate it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their number; null is no key."""
    known = df.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def not_among(column: str, values: Iterable) -> Column:
    return ~F.col(column).isin(*values)


def accepted_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(not_among(column, values))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key, where they have one, is no key of the parent."""
    keys = parent.select(F.col(parent_column).alias("parent_key"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("parent_key"), "left_anti")


def outside(column: str, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (F.col(column) < low)
    if high is not None:
        out = out | (F.col(column) > high)
    return out


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    return df.filter(outside(column, low, high))


def share_at_most(df: DataFrame, bad: Column, limit: float) -> DataFrame:
    """One row with the share of bad rows if it exceeds the limit."""
    share = F.count_if(F.coalesce(bad, F.lit(False))) / F.count(F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.when(F.count(F.lit(1)) > 0, share).alias("share")).filter(F.col("share") > limit)


def observed(df: DataFrame, gates: Mapping[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df, and a function that tells, once df has been written, how many of its rows met each condition: they are counted on the way,
    without a job of their own."""
    if not gates:
        return df, dict
    watch = Observation()
    watched = df.observe(watch, *[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"g{i}") for i, bad in enumerate(gates.values())])
    return watched, lambda: {name: watch.get[f"g{i}"] for i, name in enumerate(gates)}


@dataclass(frozen=True)
class Gate:
    """A name and what returns the violating rows; table and bad where those are the table's rows that meet a condition."""

    name: str
    violations: Callable[[], DataFrame]
    table: DataFrame | None = None
    bad: Column | None = None


def row_gate(name: str, df: DataFrame, bad: Column) -> Gate:
    return Gate(name, lambda: df.filter(bad), df, bad)


def failures(gates: Iterable[Gate]) -> dict[str, int]:
    """Number of violations of each gate that has any: all conditions on the rows of one table are counted in one pass."""
    gates, counts = list(gates), {}
    tables = {id(g.table): g.table for g in gates if g.table is not None}
    for key, df in tables.items():
        mine = [g for g in gates if id(g.table) == key]
        row = df.agg(*[F.count_if(F.coalesce(g.bad, F.lit(False))).alias(f"g{i}") for i, g in enumerate(mine)]).first()
        counts |= {g.name: row[i] for i, g in enumerate(mine)}
    counts |= {g.name: g.violations().count() for g in gates if g.table is None}
    return {g.name: counts[g.name] for g in gates if counts[g.name]}


def standard_gates(silver: DataFrame, fact: DataFrame, product: DataFrame, brand: DataFrame, category: DataFrame, country: DataFrame, nutriscore: DataFrame) -> list[Gate]:
    """The gates of a whole run, over silver and gold tables."""
    from larder.functions import rules
    from larder.operators.gold import BENCHMARKS

    tiers = ("Low", "Medium", "High", "Unknown")
    gates = [
        row_gate("silver.barcode not null", silver, F.col("barcode").isNull()),
        Gate("silver.barcode unique", lambda: unique(silver, "barcode")),
        row_gate("silver.sugar_tier accepted", silver, not_among("sugar_tier", tiers)),
        row_gate("silver.energy in range", silver, outside("energy_kcal_per_100g", 0, rules.KCAL_LIMIT)),
        row_gate("silver.sugars not negative", silver, outside("sugars_100g", 0)),
        Gate("silver.energy mostly known", lambda: share_at_most(silver, F.col("energy_kcal_per_100g").isNull(), 0.5)),
        Gate("silver.barcode mostly ean", lambda: share_at_most(silver, ~rules.is_ean(F.col("barcode")), 0.05)),
        row_gate("fact.energy in range", fact, outside("energy_kcal_per_100g", 0, rules.KCAL_LIMIT)),
        row_gate("fact.sugar_tier accepted", fact, not_among("sugar_tier", tiers)),
        row_gate("dim_product.tier accepted", product, not_among("data_quality_tier", ("Complete", "Sparse"))),
        row_gate("dim_nutriscore.grade accepted", nutriscore, not_among("grade", (*rules.GRADES, "Unknown"))),
        Gate("dim_product.product_id unique", lambda: unique(product, "product_id")),
    ]
    for table, df, keys in (
        ("dim_product", product, ("product_key", "product_id")),
        ("dim_brand", brand, ("brand_key", "brand_name")),
        ("dim_category", category, ("category_key",)),
        ("dim_country", country, ("country_key",)),
        ("dim_nutriscore", nutriscore, ("nutriscore_key", "grade")),
        ("fact", fact, ("product_key", "brand_key", "category_key", "snapshot_date")),
    ):
        gates += [row_gate(f"{table}.{k} not null", df, F.col(k).isNull()) for k in keys]
        if table != "fact":
            gates.append(Gate(f"{table}.{keys[0]} unique", lambda d=df, k=keys[0]: unique(d, k)))
    for key, df in (("product_key", product), ("brand_key", brand), ("category_key", category)):
        gates.append(Gate(f"fact.{key} has parent", lambda d=df, k=key: relationships(fact, k, d, k)))
    for name, limit, _ in BENCHMARKS.values():
        gates.append(row_gate(f"fact.{name} in range", fact, outside(name, 0, limit)))
    return gates
