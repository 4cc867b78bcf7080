"""Bronze: landed pages as rows, their products kept as text, with lineage columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.schemas import BRONZE, PAGE, aligned


class NoRows(RuntimeError):
    """A step that must have rows found none."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row; one row is looked for, not all counted."""
    if df.isEmpty():
        raise NoRows(f"no rows: {what}")
    return df


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page files of a folder; hidden files are skipped, the products' array is read as text."""
    return spark.read.schema(PAGE).option("multiLine", True).json(folder)


def bronze(pages: DataFrame, run_id: str | None = None, ingested_at: Column | None = None, source: str = "product_api") -> DataFrame:
    """Pages in the bronze schema. Without run_id the pages' own ids stay."""
    given = {
        "ingest_layer": F.lit("bronze"),
        "source_system": F.lit(source),
        "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
        "api_page_number": F.coalesce(F.col("api_page_number"), F.col("page_number").cast("long")),
        "raw_products_json": F.col("products"),
    }
    if run_id is not None:
        given["ingest_run_id"] = F.lit(run_id)
    return aligned(pages, BRONZE, **given)


def add(df: DataFrame, path: str) -> None:
    """Appends to a table as it is: landing pages twice has them twice. Columns that the table lacks are added to it."""
    _by_run(df).write.mode("append").partitionBy("ingest_run_id").parquet(path)


def _by_run(df: DataFrame) -> DataFrame:
    """Rows of a run together, so that it gets few files; Spark splits large runs and merges small ones."""
    return df.hint("rebalance", "ingest_run_id")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """The table with the columns of all its files; older rows have nulls in newer columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Appends to a table partitioned by run, so that one run is read without the others.

    Rerunning a run replaces its partition: landing twice doesn't double pages.
    """
    _by_run(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_run_id").parquet(path)


def read(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The table, or one run of it; columns that later files added are merged in."""
    df = aligned(spark.read.option("mergeSchema", True).option("recursiveFileLookup", False).schema(BRONZE).parquet(path), BRONZE)
    return df if run_id is None else df.filter(F.col("ingest_run_id") == run_id)
