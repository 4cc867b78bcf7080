"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Every document is encoded once, closed with END and, if longer than a sequence, cut into pieces;
pieces are stored. A full piece is a sequence by itself and isn't moved. The others are dealt out at
random over islands of about ISLAND pieces. On an island a small population of packings evolves:
crossover injects whole well-filled bins of one packing into another, removes the bins that hold
duplicates of the injected pieces and puts the displaced pieces back by best fit, longest first;
fitness is the mean square fill of the bins. Then the islands' elites (the length patterns of their
best-filled bins) migrate along a ring, and a second epoch starts from the stored packing with the
immigrants as further donors, wherever the island has pieces of those lengths. Bins that are left
poorly filled are dissolved and their pieces meet anew, on as many islands of the same size as they
fill, again and again: what is wasted is about one bin in all, not one an island. Where that saves no bins any more
(pieces that can't share a bin, such as many of just over half a sequence), the packing before it stands.

An island is a bounded group at every level: pieces are dealt by a stored random number, not by document or
source, so neither copies nor a hot source make one larger, and the number of islands follows the number
of pieces left. Results are stored between epochs.

Defined cases: null text counts as empty; an empty text is the one token END; a document of
2048 tokens or fewer is one piece; of a longer one the first piece is the shorter one, all others
are full; equal rows are packed once each; extra columns aren't read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import dropped, small_batches, stored, texts_of
from larder.llm.tokens import crc, default_vocabulary, encoder

CAPACITY = 2048
END = 0
#: Pieces on an island, packings in its population, generations of an epoch, elite bins that migrate.
ISLAND, POPULATION, GENERATIONS, ELITES = 4096, 4, 6, 24
#: A bin is well filled from here on; the share of poorly filled bins that another level must save to be followed by one more.
WELL, GAIN = 0.995, 0.002

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = END.to_bytes(4, "little")


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces, with salt, a random number that deals them out."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, row = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for b in small_batches(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), texts_of(b), strict=True):
                ids = encode(text) + _END
                n = len(ids) // 4
                start, stop, k = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    salt = xxhash.xxh3_64_intdigest(f"{task}|{row}".encode()) >> 1
                    out.append((doc_id, k, start, stop - start, crc(part), salt))
                    start, stop, k, row = stop, stop + capacity, k + 1, row + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + ", salt long")


class _Bins:
    """A packing: bins of item numbers, with best fit by remaining room in constant time."""

    __slots__ = ("size", "capacity", "items", "room", "by_room", "mask")

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.items: list[list[int] | None] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.mask = 0  # bit r: some bin has room r

    def _index(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].add(b)
        self.mask |= 1 << r

    def _unindex(self, b: int) -> None:
        r = self.room[b]
        bins = self.by_room[r]
        bins.discard(b)
        if not bins:
            self.mask &= ~(1 << r)

    def add(self, items: list[int]) -> None:
        self.items.append(items)
        self.room.append(self.capacity - sum(self.size[i] for i in items))
        self._index(len(self.items) - 1)

    def remove(self, b: int) -> list[int]:
        items = self.items[b]
        self._unindex(b)
        self.items[b] = None
        return items

    def best_fit(self, items: list[int]) -> None:
        """Each item to the bin it fills best, or to a new one."""
        for i in items:
            size = self.size[i]
            fitting = self.mask >> size
            if fitting:
                r = size + (fitting & -fitting).bit_length() - 1
                b = min(self.by_room[r])
                self._unindex(b)
                self.items[b].append(i)
                self.room[b] -= size
                self._index(b)
            else:
                self.add([i])

    def bins(self) -> list[list[int]]:
        return [x for x in self.items if x]

    def fitness(self) -> float:
        used = [self.capacity - r for x, r in zip(self.items, self.room, strict=True) if x]
        return sum(u * u for u in used) / (len(used) * self.capacity**2) if used else 0.0


def _packed(size: list[int], order: list[int], capacity: int) -> _Bins:
    out = _Bins(size, capacity)
    out.best_fit(order)
    return out


def crossover(receiver: _Bins, injected: list[list[int]]) -> _Bins:
    """The receiver with whole bins injected, bins with duplicates removed, displaced items put back by best fit."""
    size, capacity = receiver.size, receiver.capacity
    new = {i for b in injected for i in b}
    child, displaced = _Bins(size, capacity), []
    for b in receiver.bins():
        if new.isdisjoint(b):
            child.add(list(b))
        else:
            displaced.extend(i for i in b if i not in new)
    for b in injected:
        child.add(list(b))
    displaced.sort(key=lambda i: (-size[i], i))
    child.best_fit(displaced)
    return child


def _instances(patterns: list[list[int]], size: list[int]) -> list[list[int]]:
    """Bins of the island's own items with the immigrants' lengths, as far as it has them."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(size):
        stock[s].append(i)
    out = []
    for pattern in patterns:
        taken: list[int] = []
        for s in pattern:
            if not stock.get(s):
                break
            taken.append(stock[s].pop())
        if len(taken) == len(pattern):
            out.append(taken)
        else:
            for i in taken:
                stock[size[i]].append(i)
    return out


def evolve(size: list[int], capacity: int, seed: int, start: list[list[int]] | None = None, immigrants: list[list[int]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing found of items with these sizes, as lists of item numbers."""
    if not size:
        return []
    rng = np.random.default_rng(seed)
    order = np.lexsort((np.arange(len(size)), -np.asarray(size)))
    people = []
    if start:
        given = _Bins(size, capacity)
        for b in start:
            given.add(list(b))
        people.append(given)
    while len(people) < max(2, population):
        # Best fit decreasing, then the same with ever more disturbed orders.
        noise = 0.03 * len(people) * (bool(people))
        keys = np.asarray(size) * (1 + noise * rng.standard_normal(len(size)))
        people.append(_packed(size, (order if not people else np.argsort(-keys, kind="stable")).tolist(), capacity))
    donors = _instances(list(immigrants), size)
    least = math.ceil(sum(size) / capacity)
    people.sort(key=lambda p: -p.fitness())
    for _ in range(generations):
        if len(people[0].bins()) <= least:
            break
        children = []
        for k in range(len(people)):
            receiver, giver = (people[i] for i in rng.choice(len(people), 2, replace=False))
            if donors and k == 0:
                good = donors
            else:
                good = [x for x, r in zip(giver.items, giver.room, strict=True) if x and r <= (1 - WELL) * capacity]
            if not good:
                # Nowhere a well-filled bin: the fullest quarter.
                fullest = sorted((k for k, x in enumerate(giver.items) if x), key=lambda k: giver.room[k])
                good = [giver.items[k] for k in fullest[: max(1, len(fullest) // 4)]]
            n = int(rng.integers(1, max(2, len(good) // 2 + 1)))
            pick = rng.choice(len(good), min(n, len(good)), replace=False)
            children.append(crossover(receiver, [good[i] for i in pick]))
        people = sorted(people + children, key=lambda p: -p.fitness())[: max(2, population)]
    return people[0].bins()


_STATE = PIECE + ", salt long, island long, bin int, elite array<int>"


def _epoch(level: int, islands: int, capacity: int, last: bool):
    """The step of one island: evolve, then hand out pieces with bins and, before migration, the elites."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        elites = [list(map(int, e)) for e in pdf["elite"] if e is not None]
        rows = pdf[pdf["elite"].isna()].sort_values(["salt", "piece"], kind="stable").reset_index(drop=True)
        island = int(pdf["island"].iloc[0])
        size = rows["length"].astype(int).tolist()
        start = [list(g) for g in rows.groupby("bin", sort=True).indices.values()] if len(rows) and rows["bin"].iloc[0] >= 0 else None
        start = [[int(i) for i in b] for b in start] if start else None
        packing = evolve(size, capacity, 1_000_003 * level + island, start, elites)
        fill = [sum(size[i] for i in b) for b in packing]
        at = np.full(len(rows), -1, np.int64)
        for k, b in enumerate(packing):
            at[b] = k
        out = rows.copy()
        out["bin"] = at
        if last:
            offset, used = np.zeros(len(rows), np.int64), np.asarray(fill)
            for b in packing:
                sizes = [size[i] for i in b]
                offset[b] = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            out["sequence_id"] = (level << 56) + (island << 24) + at
            out["offset"] = offset
            # With one island there is nowhere to go on.
            out["loose"] = (used[at] < WELL * capacity) & (islands > 1) if len(rows) else pd.Series([], dtype=bool)
            return out[["doc_id", "piece", "start", "length", "ids_crc32", "salt", "sequence_id", "offset", "loose"]]
        best = sorted(range(len(packing)), key=lambda k: (-fill[k], len(packing[k])))[:ELITES]
        if islands > 1 and best:
            moved = pd.DataFrame({"island": (island + 1) % islands, "elite": [[size[i] for i in packing[k]] for k in best]})
            out = pd.concat([out, moved], ignore_index=True)
        for c in ("piece", "start", "length", "ids_crc32", "salt", "bin"):
            out[c] = out[c].astype("Int64")
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "salt", "island", "bin", "elite"]]

    return step


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place in it."""
    cut = stored(pieces(docs, vocabulary, capacity), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.filter(F.col("length") == capacity)
    done = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(names)]
    loose = cut.filter(F.col("length") < capacity)
    n, level = loose.count(), 0
    out = PIECE + ", salt long, sequence_id long, offset long, loose boolean"
    kept, bins = None, None
    while n:
        islands = math.ceil(n / ISLAND)
        dealt = loose.select(*cut.columns, F.pmod(F.xxhash64("salt", F.lit(level)), F.lit(islands)).alias("island"), F.lit(-1).alias("bin"), F.lit(None).cast("array<int>").alias("elite"))
        first = stored(dealt.groupBy("island").applyInPandas(_epoch(level, islands, capacity, False), _STATE), f"epoch{level}")
        second = stored(first.groupBy("island").applyInPandas(_epoch(level, islands, capacity, True), out), f"packed{level}")
        dropped(first)
        # Every sequence has one piece at its start.
        now = second.filter("offset = 0").count()
        if kept is not None and now > bins:
            done.append(kept.select(names))
            dropped(second)
            break
        saved = bins - now if kept is not None else now
        done.append(second.filter("NOT loose").select(names))
        kept = loose = second.filter("loose")
        n, level, bins = loose.count(), level + 1, loose.filter("offset = 0").count()
        if saved < max(1, GAIN * now):
            done.append(kept.select(names))
            break
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
