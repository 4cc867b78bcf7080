"""Schemas of what is read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT_FIELDS = (
    "code product_name brands categories countries quantity serving_size energy_100g energy-kcal_100g proteins_100g fat_100g carbohydrates_100g "
    "sugars_100g salt_100g sodium_100g fiber_100g nutriscore_score nutriscore_grade nova_group ingredients_text allergens packaging last_modified_t"
).split()
#: Asked of the source, but not parsed further.
EXTRA_FIELDS = ["image_url", "pnns_groups_1", "pnns_groups_2"]

PRODUCT = T.StructType([T.StructField(n, T.StringType()) for n in PRODUCT_FIELDS])
PRODUCTS = T.ArrayType(PRODUCT)

PAGE = T.StructType(
    [
        T.StructField("ingest_run_id", T.StringType()),
        T.StructField("api_page_number", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("page_size", T.IntegerType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("total_products_reported", T.LongType()),
        # An array read as text: whatever the products hold, the landing schema stays the same.
        T.StructField("products", T.StringType()),
    ]
)

BRONZE = T.StructType(
    [
        T.StructField("ingest_run_id", T.StringType()),
        T.StructField("ingest_layer", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("api_page_number", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("page_size", T.IntegerType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("total_products_reported", T.LongType()),
        T.StructField("raw_products_json", T.StringType()),
    ]
)

LOOKUP = T.StructType([T.StructField(n, T.StringType()) for n in ("alias", "iso_code", "display_name")])
GRADE_LOOKUP = T.StructType(
    [T.StructField("grade", T.StringType()), T.StructField("score_min", T.IntegerType()), T.StructField("score_max", T.IntegerType()), T.StructField("description", T.StringType()), T.StructField("color_indicator", T.StringType())]
)


def aligned(df: DataFrame, schema: T.StructType, **given: Column) -> DataFrame:
    """df in the columns, order and types of schema: given columns win, missing ones are typed nulls."""
    have = set(df.columns)
    return df.select(*[given.get(f.name, F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns but some."""
    return df.drop(*names)
