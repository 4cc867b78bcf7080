"""What the corpus operators share: tables, shared storage and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import ship
from larder.storage import dropped, fresh, shared_folder, stored

__all__ = ["appended", "dropped", "fresh", "in_sample", "same", "sample_bound", "shared_folder", "ship", "small_batches", "stored", "table", "texts_of", "unit", "with_fields"]

#: Names that no input column is expected to have start with this.
OWN = "__larder_"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """schema and the fields, which replace those of the same name (case folded)."""
    taken = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in taken] + list(fields))


def appended(batch: pa.RecordBatch, names: Iterable[str], columns: Iterable[pa.Array]) -> pa.RecordBatch:
    """batch with columns added behind, in place of those of the same name."""
    new = dict(zip(names, columns, strict=True))
    taken = {n.lower() for n in new}
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in taken]
    arrays = [batch.column(i) for i in kept] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + list(new))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, at most so many at once: long texts stay few in memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from an MD5 of the parts: the same in any engine that has MD5."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def in_sample(hashed: Column, share: float) -> Column:
    """Whether a row belongs to a hash-chosen share of all, for shares down to 1 in 2**62."""
    return F.shiftrightunsigned(hashed, 1) < F.lit(sample_bound(share))


def sample_bound(share: float) -> int:
    """The number that a share of all 63-bit hashes lies below."""
    return min((1 << 63) - 1, max(1, int(share * (1 << 63)))) if share > 0 else 0
