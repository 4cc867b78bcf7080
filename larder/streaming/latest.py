"""Keep-latest as a stateful stream: the newest revision of each key, as rows come.

Each Arrow batch is first cut down to its newest row a key, so a hot key sends a row a batch, not all its rows, to the task
that keeps its state. There a key's few rows stay plain rows: a data frame for each key costs far more than its state. The state is a
key's newest revision so far, in RocksDB; a row is sent on when it is newer. With a watermark, rows that are later than it are left out, and a key's state goes (by a timer, so in event time: the same in a replay) when
the watermark has passed its revision by the time to live. A late row may then be sent on again: the guarded upsert
behind it lets it lose there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larder.operators import upsert

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _newest(rows: pd.DataFrame, keys: Sequence[str], order: Sequence[str]) -> pd.DataFrame:
    """The last row of each key in the order of some columns; missing values are smallest."""
    return rows.sort_values(list(order), na_position="first", kind="stable").drop_duplicates(list(keys), keep="last")


def _place(row: Row, order: Sequence[str]) -> tuple:
    """A row's cells in these columns as the state takes them; NaN is missing, as in _newest."""
    return tuple(None if v is None or v != v else v for v in (row[c] for c in order))


def _sortable(place: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in place)


class Newest(StatefulProcessor):
    """live_ms: how long after its revision, in event time, a key's state goes; None: never."""

    def __init__(self, schema: T.StructType, order: Sequence[str], live_ms: int | None) -> None:
        self.schema, self.order, self.live_ms = schema, list(order), live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("newest", T.StructType([self.schema[c] for c in self.order]))

    def _known(self) -> tuple | None:
        """The state's place; its times come without the zone (the worker's) that those of rows have."""
        known = self.best.get()
        timed = [isinstance(self.schema[c].dataType, T.TimestampType) for c in self.order]
        return None if known is None else tuple(v.astimezone() if t and v is not None else v for v, t in zip(known, timed, strict=True))

    def _end(self, revision: datetime) -> int:
        return int(revision.timestamp() * 1000) + self.live_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: _sortable(_place(r, self.order)))
        place, known = _place(new, self.order), self._known()
        if known is None or _sortable(place) > _sortable(known):
            self.best.update(place)
            if self.live_ms is not None and place[0] is not None:
                self.handle.registerTimer(self._end(place[0]))
            yield new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._known()
        # An older revision's timer says nothing about a newer one.
        if known is not None and self._end(known[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest(rows: DataFrame, keys: Sequence[str], revision: str, ties: Sequence[str] = (), late: str | None = None, live: int = 7 * 24 * 3600) -> DataFrame:
    """A stream of the rows that are newer than all before them of their key. late: how far rows may be behind the newest revision
    of all, which is a time then; the state of a key goes live seconds after its revision."""
    order, schema = [revision, *ties], rows.schema
    ordered = T.StructType([*[schema[c] for c in order], *[f for f in schema if f.name not in order]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _newest(b, keys, order)

    few = rows.select(*ordered.names).mapInPandas(cut, ordered)
    if late:
        few = few.withWatermark(revision, late)
    processor = Newest(ordered, order, 1000 * live if late else None)
    return few.groupBy(*keys).transformWithState(processor, ordered, "Update", "EventTime" if late else "None").select(*schema.names)


def keep_latest(rows: DataFrame, keys: Sequence[str], revision: str, table: str, checkpoint: str, ties: Sequence[str] = (), late: str | None = None, live: int = 7 * 24 * 3600, partitions: int | None = None) -> StreamingQuery:
    """Runs through all rows that there are and upserts the newest of each key into a stored table, then stops.

    partitions: of the state, which a checkpoint keeps for good; by default as many as shuffles have.
    """
    conf = rows.sparkSession.conf
    conf.set(STORE, ROCKS)
    usual = conf.get(PARTITIONS)
    conf.set(PARTITIONS, str(partitions or usual))

    def batch(new: DataFrame, _: int) -> None:
        # One action only: each would run the batch, and its state, again. An upsert begins by storing its rows.
        upsert.upsert(new, table, keys, revision=revision)

    stream = latest(rows, keys, revision, ties, late, live)
    try:
        return stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PARTITIONS, usual)
