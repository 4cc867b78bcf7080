"""Exact deduplication by a two-pass Bloom filter.

Whole texts are read once for their digests, which are stored with doc_id. Pass one sets two slots of
a Bloom filter for every digest and counts, per slot, whether more than one row hit it (map-side
combined, slot numbers move). Pass two tests every digest: a text that occurs twice has only slots hit
twice, so a row with a slot that was hit once is unique and passes straight through. Only the
others, the repeats and a few false alarms, shuffle, and an exact aggregation on the full SHA-256
digest decides among them, on digest and doc_id alone.

A filter has MAX_SLOTS slots at most. A corpus too large for one is split by digest into as many
buckets as it needs, dealt out once, each with a filter and a pass over its own stored digests, so the share
of false alarms is the same at every size and all digests are read a fixed number of times. To drop copies, documents are then tested against a
second filter that holds the repeated digests only: of each task's rows that it suspects, those with
the largest doc_id of their text in the batch meet the groups' table, all others stay where they are. Where
even the repeated digests are too many for one filter, more rows are suspected; results are exact.

Defined cases: null text counts as empty, so null and empty texts are copies of each other; of
equal texts the row with the largest doc_id stays (null ids are smallest); several rows that share
both text and the largest doc_id are all marked as kept by `exact_copies` (the mark is a function
of doc_id) while `drop_exact_copies` lets one of them through; an empty table gives an empty
result; extra columns ride along, and input columns with the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import OWN, appended, dropped, fresh, small_batches, stored, texts_of, with_fields

#: Slots per row, and the largest filter: 2**28 slots are 32 MB.
SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 28
SEGMENT = 32768

DIGEST, MAYBE = f"{OWN}sha256", f"{OWN}maybe"


def _digests(texts: list[str]) -> list[bytes]:
    """SHA-256 of the UTF-8 text with A-Z lower-cased; bytes.lower touches ASCII only."""
    return [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).digest() for t in texts]


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        yield appended(b, [DIGEST], [pa.array(_digests(texts_of(b)), pa.binary())])


def digested(docs: DataFrame) -> DataFrame:
    """docs and the digest of each whole text."""
    return docs.mapInArrow(_with_digest, with_fields(docs.schema, T.StructField(DIGEST, T.BinaryType())))


def _slots(digest: Column, n: int) -> tuple[Column, Column]:
    part = lambda i: F.conv(F.hex(F.substring(digest, i, 7)), 16, 10).cast("long")
    return F.pmod(part(1), F.lit(n)), F.pmod(part(8), F.lit(n))


def filter_size(rows: int) -> int:
    return min(MAX_SLOTS, max(SEGMENT, 1 << max(1, (SLOTS_PER_ROW * rows - 1).bit_length())))


def buckets(rows: int) -> int:
    """How many filters of the largest size so many rows take."""
    return max(1, math.ceil(rows * SLOTS_PER_ROW / MAX_SLOTS))


def filled_slots(digests: DataFrame, n_slots: int, least: int) -> np.ndarray:
    """One bit for each slot that so many rows hit at least; n_slots bits at most come to the driver."""
    slots = digests.select(F.explode(F.array(*_slots(F.col(DIGEST), n_slots))).alias("slot"))
    often = slots.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select((F.col("slot") + 1).alias("slot"))
    bitmaps = often.groupBy(F.bitmap_bucket_number("slot").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(n_slots // 8, np.uint8)
    for r in bitmaps.toLocalIterator():
        at = (r["segment"] - 1) * (SEGMENT // 8)
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def _hits(digests: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which of the digests have both of their slots in a filter."""
    n = len(bits) * 8
    d = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32).astype(np.uint64)
    hit = np.ones(len(d), bool)
    for i in (0, 7):
        h = np.zeros(len(d), np.uint64)
        for j in range(i, i + 7):
            h = (h << np.uint64(8)) | d[:, j]
        slot = (h % np.uint64(n)).astype(np.int64)
        hit &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return hit


def dealt(digests: DataFrame, n: int) -> list[DataFrame]:
    """The digests in n buckets, each a stored table of its own: written once, so that a pass reads its own rows only."""
    spark, path, name = digests.sparkSession, fresh(digests.sparkSession, "buckets"), f"{OWN}bucket"
    # The bucket comes of other bytes than the slots.
    bucket = F.pmod(F.conv(F.hex(F.substring(DIGEST, 15, 6)), 16, 10).cast("long"), F.lit(n)).cast("int")
    digests.withColumn(name, bucket).hint("rebalance", name).write.partitionBy(name).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    return [spark.read.schema(digests.schema).parquet(f"{path}/{name}={i}") for i in range(n) if f"{name}={i}" in there]


def suspected(digests: DataFrame) -> DataFrame:
    """The digests with a mark that is false only where no other row has the same digest. Stored."""
    rows = digests.count()
    n = buckets(rows)
    parts = [digests] if n == 1 else dealt(digests, n)
    out = None
    for mine in parts:
        bits = digests.sparkSession.sparkContext.broadcast(filled_slots(mine, filter_size(math.ceil(rows / n)), 2))

        def test(batches: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield appended(b, [MAYBE], [pa.array(_hits(b.column(b.schema.get_field_index(DIGEST)), bits.value))])

        part = stored(mine.mapInArrow(test, with_fields(digests.schema, T.StructField(MAYBE, T.BooleanType()))), "suspects")
        bits.destroy()
        if n > 1:
            dropped(mine)
        out = part if out is None else out.unionByName(part)
    return out


def _groups(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    digests = stored(digested(docs.select("doc_id", "text")).drop("text"), "digests")
    marked = suspected(digests)
    dropped(digests)
    alone = marked.filter(~F.col(MAYBE)).select("doc_id", DIGEST, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = marked.filter(MAYBE).drop(MAYBE)
    # Stored, so that both sides of the join are plain exchanges, which Spark splits where one text has very many copies.
    groups = stored(_groups(suspects).select(F.col(DIGEST).alias(f"{OWN}digest"), "keep_id", "group_size"), "groups")
    decided = suspects.join(groups, F.col(DIGEST) == F.col(f"{OWN}digest")).select("doc_id", DIGEST, "keep_id", "group_size")
    return alone.unionByName(decided).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(DIGEST)).alias("text_sha256"),
    )


def _tested(bits) -> Callable:
    """Documents with digest and mark; of a batch's suspects with one text only the one with the largest doc_id."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            digests = _digests(texts_of(b))
            hit = _hits(pa.array(digests, pa.binary()), bits.value)
            best: dict[bytes, tuple] = {}
            for i, doc_id in enumerate(b.column(b.schema.get_field_index("doc_id")).to_pylist()):
                if hit[i]:
                    best[digests[i]] = max(best.get(digests[i], (False, 0, -1)), (doc_id is not None, doc_id or 0, i))
            stays = ~hit
            stays[[i for *_, i in best.values()]] = True
            yield appended(b, [DIGEST, MAYBE], [pa.array(digests, pa.binary()), pa.array(hit)]).filter(pa.array(stays))

    return test


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies: unique rows aren't moved, of equal texts the largest doc_id stays."""
    names, keep, digest = docs.columns, f"{OWN}keep", f"{OWN}digest"
    digests = stored(digested(docs.select("doc_id", "text")).drop("text"), "digests")
    marked = suspected(digests)
    dropped(digests)
    groups = stored(_groups(marked.filter(MAYBE)).filter("group_size > 1"), "groups")
    dropped(marked)
    bits = docs.sparkSession.sparkContext.broadcast(filled_slots(groups, filter_size(groups.count()), 1))
    groups = groups.select(F.col(DIGEST).alias(digest), F.col("keep_id").alias(keep))
    tested = docs.mapInArrow(_tested(bits), with_fields(docs.schema, T.StructField(DIGEST, T.BinaryType()), T.StructField(MAYBE, T.BooleanType())))
    alone = tested.filter(~F.col(MAYBE)).select(*names)
    suspects = tested.filter(MAYBE).join(groups, F.col(DIGEST) == F.col(digest), "left")
    false_alarms = suspects.filter(F.col(digest).isNull()).select(*names)
    keepers = suspects.filter(F.col(digest).isNotNull() & F.col("doc_id").eqNullSafe(F.col(keep))).dropDuplicates([DIGEST])
    return alone.unionByName(false_alarms).unionByName(keepers.select(*names))
