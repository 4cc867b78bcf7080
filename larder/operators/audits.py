"""The audit of runs kept up by subtracting and adding, from the change feed of a stored silver table.

Every row of silver stands for a few counted values of its run: itself, the values whose variety is
counted, its times, and the conditions that it meets. The state is how often each (run, name, value) occurs, in a
table of its own; a change of silver subtracts the values of rows as they were and adds those of rows as they are, so a distinct
count or an earliest time is right again when the last row that had it is gone. The state's manifest
says which version of silver it stands for, so a refresh that is run again, or by two at once, is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import gold, upsert

KEYS = ("ingest_run_id", "name", "value")
ROWS, FIRST, LAST = "rows", "first_at", "last_at"
#: The property of the state that names silver's version.
SOURCE = "silver_version"


def counted_values(rows: DataFrame, sign: Column) -> DataFrame:
    """ingest_run_id, name, value and n: how often each value occurs, signed."""
    text = lambda c: F.col(c).cast("string")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    values = [one(ROWS, F.lit("")), one(FIRST, micros("ingested_at")), one(LAST, micros("silver_processed_at"))]
    values += [one(n, text(c)) for c, n in gold.DISTINCT.items()]
    values += [one(n, F.when(p, "")) for n, p in gold.audited().items()]
    flat = rows.select("ingest_run_id", sign.cast("long").alias("n"), F.inline(F.array(*values))).filter("value IS NOT NULL")
    return flat.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def summed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added up; what doesn't occur any more goes."""
    return old.unionByName(new).groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def refresh(spark: SparkSession, silver_root: str, state_root: str) -> int:
    """Brings the state up to silver's current version and returns that. Only buckets of silver that changed are read,
    unless the version that the state stands for isn't kept any more: then it is made anew."""
    until = upsert.version(spark, silver_root)
    if until is None:
        raise FileNotFoundError(silver_root)
    known = upsert.manifest(spark, state_root).properties.get(SOURCE) if upsert.exists(spark, state_root) else None
    since = int(known) if known else None
    if since == until:
        return until
    if since is not None and since not in upsert.versions(spark, silver_root):
        whole = counted_values(upsert.read(spark, silver_root, until), F.lit(1))
        upsert.overwrite(whole, state_root, keys=KEYS, properties={SOURCE: str(until)})
        return until
    feed = upsert.changes(spark, silver_root, since, until)
    sign = F.when(F.col(upsert.CHANGE).isin(upsert.INSERTED, upsert.AFTER), 1).otherwise(-1)
    upsert.upsert(counted_values(feed, sign), state_root, KEYS, properties={SOURCE: str(until)}, expected={SOURCE: known}, how=summed)
    return until


def audit(state: DataFrame, built_at: Column | None = None) -> DataFrame:
    """The audit as gold has it, from the counted values."""
    name, n = F.col("name"), F.col("n")
    at = lambda best, which: F.timestamp_micros(best(F.when(name == which, F.col("value").cast("long"))))
    times = lambda which: F.coalesce(F.sum(F.when(name == which, n)), F.lit(0))
    conditions = gold.audited()
    counted = state.groupBy("ingest_run_id").agg(
        at(F.min, FIRST).alias("run_ingested_at"),
        at(F.max, LAST).alias("silver_completed_at"),
        times(ROWS).alias("total_products_processed"),
        *[F.count_if(name == v).alias(f"unique_{v}") for v in gold.DISTINCT.values()],
        *[times(c).alias(f"{c}_count") for c in conditions],
    )
    share = lambda c: F.round(F.col(f"{c}_count") / F.nullif(F.col("total_products_processed"), F.lit(0)) * 100, 2)
    rows = counted.withColumns({f"{c}_pct": share(c) for c in gold.SHARES} | {"audit_built_at": F.current_timestamp() if built_at is None else built_at})
    return rows.select(*gold.audit_columns())
