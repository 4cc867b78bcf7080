"""The same steps as a stream: landed pages to an upserted silver table.

The stream's checkpoint takes the place of run ids; each batch is cleansed by the batch code and
merged with the guard against older revisions, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import upsert
from larder.operators.bronze import bronze
from larder.operators.silver import silver
from larder.sources.schemas import PAGE


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New page files of a folder and its subfolders."""
    return spark.readStream.schema(PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).json(folder)


def upsert_silver(pages: DataFrame, lookup: DataFrame, table: str, checkpoint: str, processed_at: Column | None = None) -> StreamingQuery:
    """Runs through all pages that there are, then stops."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            upsert.upsert(silver(bronze(rows), lookup, processed_at), table, zones=["ingest_run_id"])

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_per_hour(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pages and products by hour of fetching, as append-only rows once an hour can't change any more."""
    at = pages.withColumn("at", F.to_timestamp("fetched_at")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 hour").alias("hour")).agg(F.count("*").alias("n_pages"), F.sum("page_size").alias("n_products"))
