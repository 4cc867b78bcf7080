"""Profiles of the tables: completeness, distributions, outliers, health of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.gold import count_where, percent_where


def of_run(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """One run's rows, or all."""
    return df if run_id is None else df.filter(F.col("ingest_run_id") == run_id)


def latest_run(df: DataFrame, run: str = "ingest_run_id") -> DataFrame:
    """The rows of the largest run id: joined with a table of one row."""
    last = df.agg(F.max(run).alias("last_run"))
    return df.join(F.broadcast(last), F.col(run) == F.col("last_run")).drop("last_run")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def top(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values; equal numbers in the order of the values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), *columns).limit(k)


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, missing ones and their share in percent; one pass over df."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[count_where(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(columns))
    rows = counts.selectExpr("n_rows", f"stack({len(columns)}, {stack}) AS (column_name, n_missing)")
    return rows.withColumn("missing_pct", F.round(100 * F.col("n_missing") / F.nullif(F.col("n_rows"), F.lit(0)), 2))


def samples(df: DataFrame, condition: Column, columns: Sequence[str], k: int) -> DataFrame:
    """k rows that meet a condition, the first in the order of the columns."""
    return df.filter(condition).select(*columns).orderBy(*columns).limit(k)


def scorecard(df: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """One row: rows, distinct keys and how many rows meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(key).alias("distinct_keys"), *[count_where(p).alias(n) for n, p in checks.items()])


def percentages(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *[percent_where(p).alias(n) for n, p in checks.items()])


def histogram(df: DataFrame, column: str, width: float, low: float, high: float) -> DataFrame:
    """Rows by bins of equal width between two limits."""
    bin_ = F.floor((F.col(column) - low) / width) * width + low
    return df.filter(F.col(column).between(low, high)).groupBy(bin_.cast("double").alias("bin")).agg(F.count("*").alias("n_rows"))


def run_health(audit: DataFrame, now: Column) -> DataFrame:
    """Of the latest run: its numbers and the hours since it was completed; beside them products overall."""
    last = audit.agg(
        F.sum("unique_barcodes").alias("unique_products"),
        F.max_by("total_products_processed", "ingest_run_id").alias("products_latest_run"),
        F.max_by("nutriscore_mismatch_pct", "ingest_run_id").alias("mismatch_pct"),
        F.max_by("missing_kcal_pct", "ingest_run_id").alias("missing_kcal_pct"),
        F.max("silver_completed_at").alias("completed_at"),
    )
    return last.withColumn("hours_since", F.round((F.unix_timestamp(now) - F.unix_timestamp("completed_at")) / 3600, 2))


#: Volume and quality of a run, as the table of runs shows them.
RUN_COLUMNS = ("ingest_run_id", "run_ingested_at", "silver_completed_at", "total_products_processed", "unique_barcodes", "nutriscore_mismatch_count", "nutriscore_mismatch_pct", "missing_kcal_count", "missing_kcal_pct", "invalid_ean_pct")
#: What is drawn over runs.
TRENDS = ("total_products_processed", "missing_kcal_pct", "nutriscore_mismatch_pct")


def run_table(audit: DataFrame) -> DataFrame:
    """All runs with their volume and quality."""
    return audit.select(*RUN_COLUMNS)


def run_trends(audit: DataFrame, drop: float = 0.5) -> DataFrame:
    """Three lines over runs: measure, run, value, value of the run before, their difference, and whether the value fell below
    so large a share of the one before (fewer products: the fetch or the source failed). A line has a row a run."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in TRENDS])
    points = audit.select("ingest_run_id", F.inline(values))
    before = F.lag("value").over(Window.partitionBy("measure").orderBy("ingest_run_id"))
    lines = points.withColumn("previous", before)
    return lines.withColumns({"change": F.round(F.col("value") - F.col("previous"), 2), "dropped": F.coalesce(F.col("value") < drop * F.col("previous"), F.lit(False))})


def tables(spark: SparkSession, databases: Sequence[str]) -> DataFrame:
    """Tables of some databases, from the catalog."""
    have = {d.name for d in spark.catalog.listDatabases()}
    rows = [(d, t.name, t.tableType) for d in databases if d in have for t in spark.catalog.listTables(d)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string").orderBy("table_schema", "table_name")


def described(df: DataFrame) -> DataFrame:
    """Column names and types, with the rows that have a value; one pass over df."""
    known = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(n).alias("col_name"), F.lit(t).alias("data_type"), F.col(f"n{i}").alias("n_known")) for i, (n, t) in enumerate(df.dtypes)])
    return known.select(F.inline(rows))
