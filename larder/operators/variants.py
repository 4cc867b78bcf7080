"""Semi-structured JSON as VARIANT, for fields outside a fixed struct, with a quarantine for what doesn't parse."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSED = "larder_variant"


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column's JSON as a variant; null where it is null or no JSON."""
    return rows.withColumn(PARSED, F.try_parse_json(column))


def split(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON parses or is null, with it as a variant, and those whose text is broken, as they are."""
    both = parsed(rows, column)
    broken = F.col(column).isNotNull() & F.col(PARSED).isNull()
    return both.filter(~broken), both.filter(broken).drop(PARSED)


def fields(rows: DataFrame, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each path (name -> path, type); null where the path or a value of that type isn't there."""
    return rows.select("*", *[F.try_variant_get(PARSED, path, kind).alias(name) for name, (path, kind) in paths.items()])


def elements(rows: DataFrame, path: str, *keep: str) -> DataFrame:
    """A row for each element of the array at a path: keep, position and element."""
    statement = f"SELECT {', '.join(keep)}, pos AS position, value AS element FROM {{rows}}, LATERAL variant_explode(variant_get({PARSED}, :path))"
    return rows.sparkSession.sql(statement, {"path": path}, rows=rows)


def members(rows: DataFrame) -> DataFrame:
    """How often each key of the top level occurs, and with values of which type."""
    pairs = rows.sparkSession.sql(f"SELECT key, schema_of_variant(value) AS kind FROM {{rows}}, LATERAL variant_explode({PARSED})", rows=rows)
    return pairs.groupBy("key", "kind").agg(F.count("*").alias("n_rows"))


def schema(rows: DataFrame) -> DataFrame:
    """One row: the schema that all the variants have together."""
    return rows.agg(F.schema_of_variant_agg(PARSED).alias("schema"))
