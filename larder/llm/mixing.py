"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target share w of the corpus and s characters of text gets the repetition rate
w * total / s. Each document draws its number of copies from the Poisson distribution with that
mean: a number in [0, 1) from an MD5 of seed and doc_id is looked up in the distribution's
cumulative table, which is made once per source. The draw depends on nothing but seed, doc_id and
the source's rate, so it is the same after a retry, on any number of executors, and in any engine
with MD5. Copies are exploded and dealt out by a second hash, which shuffles them globally.

One source may hold a third of the rows: sizes are partial sums before they shuffle, the sources'
tables are stored and, if a count of their entries stays within BROADCAST_ENTRIES, broadcast, so documents
move once, when copies are dealt by a hash that knows nothing of sources. With more entries, a table of very many sources
or of enormous rates, they are joined by source, which Spark splits where one is hot.

Defined cases: null or empty text has size 0; a source without any text gets rate 1; a null source
is a source of its own; rows with equal doc_id draw alike and have equal places (they are dealt out by their texts, too); rows
without doc_id draw by their text, so equal ones alike; target weights need not sum to 1 and a
source without one gets 0 (it is left out); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import OWN, same, stored, unit

#: Numbers in all sources' tables up to which they are broadcast: 8 MB.
BROADCAST_ENTRIES = 1_000_000
RATE, TABLE, COPY, PLACE = f"{OWN}rate", f"{OWN}cumulative", "copy", "shuffle_key"


def sizes(docs: DataFrame) -> DataFrame:
    """Characters of text by source."""
    return docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias(f"{OWN}size"))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5) -> DataFrame:
    """source and mean repetition rate, for the whole mixture to stay as large as the corpus.

    weights: target share by source; without them the share of a source is its own share to
    the given power (0: all alike, 1: as they are), made to sum to 1.
    """
    size = F.col(f"{OWN}size")
    by_source = sizes(docs)
    if weights is None:
        share = F.when(size > 0, F.pow(size, F.lit(power))).otherwise(0.0)
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(same(F.col("source"), F.lit(name)), F.lit(float(w))).otherwise(share)
    shares = by_source.withColumn(f"{OWN}share", share)
    totals = shares.agg(F.sum(f"{OWN}size").alias(f"{OWN}total"), F.sum(f"{OWN}share").alias(f"{OWN}shares"))
    rate = F.col(f"{OWN}share") / F.col(f"{OWN}shares") * F.col(f"{OWN}total") / size
    # One row of totals: the join can't grow.
    return shares.join(F.broadcast(totals)).select(F.col("source").alias(f"{OWN}source"), F.when(size > 0, rate).otherwise(1.0).alias(RATE))


def cumulative(rates: DataFrame) -> DataFrame:
    """rates with the table of P(X <= k) for k = 0, 1, ... of each source's Poisson distribution, as far as its tail matters."""
    rate = F.col(RATE)
    last = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 20)).otherwise(0).cast("int")
    steps = rates.select(f"{OWN}source", RATE, F.explode(F.sequence(F.lit(0), last)).alias("k"))
    # log p(k) = k log(rate) - rate - log(k!), summed step by step, so large rates don't underflow.
    upward = Window.partitionBy(f"{OWN}source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upward)
    logs = steps.withColumn("log_factorial", log_factorial)
    chance = F.when(rate > 0, F.exp(F.col("k") * F.log(rate) - rate - F.col("log_factorial"))).otherwise(1.0)
    sums = logs.withColumn("sum", F.sum(chance).over(upward))
    table = F.transform(F.sort_array(F.collect_list(F.struct("k", "sum"))), lambda s: s["sum"])
    return sums.groupBy(f"{OWN}source").agg(table.alias(TABLE))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, seed: str = "mix", copy: str = COPY, place: str = PLACE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Every copy of every document: docs' columns, copy (from 0) and shuffle_key, its place in the global order.

    The result is dealt out by shuffle_key and sorted by it within each partition. copy and place name
    the two columns, for tables that have such columns already.
    """
    tables = stored(cumulative(rates(docs, weights, power)), "rates")
    entries = tables.agg(F.sum(F.size(TABLE) + 8)).first()[0] or 0
    if entries <= broadcast_entries:
        tables = F.broadcast(tables)
    names = [c for c in docs.columns if c.lower() not in (copy, place)]
    # A row without an id draws by its text.
    own_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), own_text)
    drawn = unit(seed, drawn_by)
    n = F.size(F.filter(F.col(TABLE), lambda c: c <= F.col(f"{OWN}u"))).cast("int")
    joined = docs.join(tables, same(F.col("source"), F.col(f"{OWN}source"))).withColumn(f"{OWN}u", drawn)
    counted = joined.withColumn(f"{OWN}n", n).filter(F.col(f"{OWN}n") > 0)
    copies = counted.select(*names, F.explode(F.sequence(F.lit(0), F.col(f"{OWN}n") - 1)).alias(copy))
    placed = copies.withColumn(place, unit(seed, "place", drawn_by, F.col(copy).cast("string")))
    # Rows that draw alike have equal places: they are dealt out by their text as well, so that different ones don't lie in one task.
    return placed.repartition(F.col(place), F.xxhash64("text")).sortWithinPartitions(place)


def remixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """The same rows in docs' own columns."""
    return mixed(docs, weights, power, seed, f"{OWN}copy", f"{OWN}place").select(*docs.columns)


ORACLE = """
WITH size_of AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
shares AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0.0 END AS share FROM size_of),
rate_of AS (SELECT source, CASE WHEN size > 0 THEN share / (SELECT sum(share) FROM shares) * (SELECT sum(size) FROM shares) / size ELSE 1.0 END AS rate FROM shares),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rate_of),
logs AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_factorial FROM steps),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.text, CAST(('0x' || substr(md5('mix|' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u, t.cs
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT doc_id, source, text, len(list_filter(cs, lambda c: c <= u)) AS n FROM drawn)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy,
  CAST(('0x' || substr(md5('mix|place|' || doc_id || '|' || copy), 1, 13)) AS BIGINT) / 4503599627370496.0 AS shuffle_key
FROM (SELECT doc_id, source, text, n, unnest(range(0, n)) AS copy FROM counted WHERE n > 0)
"""
