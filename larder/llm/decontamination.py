"""Benchmark decontamination: an FM-index of each training shard, searched for the benchmark's windows.

A shard is as many documents of one partition as SHARD words hold; nothing is shuffled to build it. Its
words get numbers of the shard's own vocabulary, and the index (wavelet tree of the Burrows-Wheeler transform, every
sixteenth suffix position) is stored with the vocabulary and the documents' places, so it can be searched for any test set,
again and again. Windows of the benchmark go through the driver in blocks of bounded size; each block is broadcast, backward-searched in every
stored shard, all windows at once, and where a window occurs its positions are looked up and merged into removal spans. A
document's spans of all blocks are merged in one aggregation of narrow rows.

Words are runs of digits, ASCII letters in lower case and everything beyond ASCII. A window is so many consecutive words of an item;
an item of fewer words, but not none, is one window.

Memory: a shard takes some 200 MB while it is built, whatever the documents are; a document longer than
a shard is indexed in pieces that overlap by a window less one word. Occurrences are located in blocks of LOCATE rows.

Defined cases: null texts have no words; equal windows of several items count for each; items that
occur are counted and listed by item_id, so items that share an id count once, and one without an id counts
but isn't listed; every row of docs gives one row, rows with equal or no doc_id too; empty tables give an empty result
or clean documents; extra columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import dropped, small_batches, stored, texts_of
from larder.llm.fm_index import MOST, Index, Searcher

#: Consecutive words that count as a leak.
WINDOW = 10
SHARD = MOST
#: Windows of a block, and the bytes of their words.
BLOCK, BLOCK_BYTES = 100_000, 32 << 20
LOCATE = 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c in _KEPT or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


INDEX = "n int, tree binary, marks binary, samples binary, counts binary, vocabulary binary, starts binary, first binary, task long, row array<long>, doc_id array<long>, n_words array<long>"
HITS = "task long, row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<struct<item_id:long>>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class _Shard:
    """Documents as they come, until there are SHARD words."""

    def __init__(self, task: int, room: int) -> None:
        self.task, self.room = task, room
        self.clear()

    def clear(self) -> None:
        self.numbers, self.parts, self.size = _Numbers(), [], 0
        self.starts, self.first, self.row, self.doc_id, self.n_words = [], [], [], [], []

    def add(self, found: list[bytes], row: int, doc_id: int | None, first: int, n_words: int) -> None:
        part = np.zeros(len(found) + 1, np.int64)
        part[:-1] = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        for to, x in ((self.starts, self.size), (self.first, first), (self.row, row), (self.doc_id, doc_id), (self.n_words, n_words)):
            to.append(x)
        self.parts.append(part)
        self.size += len(part)

    def flushed(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        index = Index.of(np.concatenate(self.parts))
        raw = [index.tree.tobytes(), index.marks.tobytes(), index.samples.tobytes(), index.counts.tobytes(), b" ".join(self.numbers), np.array(self.starts, "<i8").tobytes(), np.array(self.first, "<i8").tobytes()]
        longs = [pa.array([x], pa.list_(pa.int64())) for x in (self.row, self.doc_id, self.n_words)]
        yield pa.RecordBatch.from_arrays([pa.array([index.n], pa.int32()), *[pa.array([x], pa.binary()) for x in raw], pa.array([self.task], pa.int64()), *longs], names=["n", "tree", "marks", "samples", "counts", "vocabulary", "starts", "first", "task", "row", "doc_id", "n_words"])
        self.clear()


def _indexed(window: int, room: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, row = _Shard(secrets.randbits(63), room), 0
    for b in small_batches(batches):
        for text, doc_id in zip(texts_of(b), b.column(b.schema.get_field_index("doc_id")).to_pylist(), strict=True):
            found = words(text)
            if shard.size + len(found) + 1 > room:
                yield from shard.flushed()
            for at in range(0, max(1, len(found) - window + 1), room - window):
                if at:
                    yield from shard.flushed()
                shard.add(found[at : at + room - 1], row, doc_id, at, len(found))
            row += 1
    yield from shard.flushed()


def indexed(docs: DataFrame, window: int = WINDOW, room: int = SHARD) -> DataFrame:
    """The stored indexes of docs' shards, for windows of so many words at most."""
    if not window < room <= MOST:
        raise ValueError(f"a shard holds more words than a window, and {MOST} at most")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(partial(_indexed, window, room), INDEX), "fm-index")


def _windowed(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        out: list[tuple[int | None, bytes]] = []
        for text, item in zip(texts_of(b), b.column(b.schema.get_field_index("item_id")).to_pylist(), strict=True):
            w = words(text)
            out += dict.fromkeys((item, b" ".join(w[i : i + window])) for i in range(max(min(1, len(w)), len(w) - window + 1)))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in out], pa.binary())], names=["item_id", "window"])


@dataclass
class Block:
    """Windows as numbers of their words, at the right end of rows, and the item of each."""

    window: int
    words: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[int | None]

    @classmethod
    def of(cls, found: list[tuple[int | None, bytes]], window: int) -> Block:
        numbers = _Numbers()
        rows, lengths = np.zeros((len(found), window), np.int64), np.zeros(len(found), np.int64)
        for k, (_, w) in enumerate(found):
            own = [numbers[x] for x in w.split(b" ")]
            rows[k, window - len(own) :], lengths[k] = own, len(own)
        return cls(window, list(numbers), rows, lengths, [i for i, _ in found])


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's windows, in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = stored(rows.mapInArrow(partial(_windowed, window), "item_id long, window binary"), "windows")
    found, size = [], 0
    for r in windows.toLocalIterator():
        if found and (len(found) >= most or size + len(r["window"]) > most_bytes):
            yield Block.of(found, window)
            found, size = [], 0
        found.append((r["item_id"], bytes(r["window"])))
        size += len(r["window"])
    if found:
        yield Block.of(found, window)
    dropped(windows)


def _occurrences(block: Block, search: Searcher, vocabulary: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and the places where they occur in a shard, some at a time."""
    numbers = {w: i for i, w in enumerate(vocabulary.split(b" "), 1)} if vocabulary else {}
    here = np.array([0, *[numbers.get(w, -1) for w in block.words]], np.int64)
    lo, hi = search.ranges(here[block.rows])
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    ends = np.cumsum(n)
    for at in range(0, int(ends[-1]) if len(ends) else 0, LOCATE):
        k = np.arange(at, min(at + LOCATE, int(ends[-1])))
        w = np.searchsorted(ends, k, "right")
        yield found[w], search.places(lo[found][w] + k - (ends - n)[w])


def _searched(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b: Block = block.value
    for batch in batches:
        for r in range(batch.num_rows):
            of = lambda name: batch.column(batch.schema.get_field_index(name))[r].as_py()  # noqa: B023, E731
            numbers = lambda name, kind: np.frombuffer(of(name), kind)  # noqa: B023, E731
            index = Index(of("n"), numbers("tree", "<u8"), numbers("marks", "<u8"), numbers("samples", "<i4"), numbers("counts", "<i4"))
            starts, first = numbers("starts", "<i8"), numbers("first", "<i8")
            edges, pairs = np.zeros(index.n + 1, np.int32), np.zeros(0, np.int64)
            for window, place in _occurrences(b, Searcher(index), of("vocabulary")):
                np.add.at(edges, place, 1)
                np.add.at(edges, place + b.lengths[window], -1)
                piece = np.searchsorted(starts, place, "right") - 1
                pairs = np.unique(np.concatenate([pairs, piece * len(b.items) + window]))
            if not len(pairs):
                continue
            # A span begins where the first window begins and ends where none is open; separators are never inside.
            turns = np.flatnonzero(np.diff(np.cumsum(edges) > 0, prepend=False))
            begin, end = turns[::2], turns[1::2]
            piece = np.searchsorted(starts, begin, "right") - 1
            offset = (first - starts)[piece]
            spans: dict[int, list] = {}
            for p, s, e in zip(piece.tolist(), (begin + offset).tolist(), (end + offset).tolist(), strict=True):
                spans.setdefault(p, []).append({"start": s, "end": e})
            items: dict[int, dict] = {p: {} for p in spans}
            for p, w in zip(*(x.tolist() for x in np.divmod(pairs, len(b.items))), strict=True):
                items[p][b.items[w]] = None
            rows, ids, n_words = of("row"), of("doc_id"), of("n_words")
            task, hit = of("task"), list(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * len(hit), pa.int64()),
                    *[pa.array([x[p] for p in hit], pa.int64()) for x in (rows, ids, n_words)],
                    pa.array([spans[p] for p in hit], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([[{"item_id": i} for i in items[p]] for p in hit], pa.list_(pa.struct([("item_id", pa.int64())]))),
                ],
                names=["task", "row", "doc_id", "n_words", "spans", "items"],
            )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or touch, of several blocks or pieces, as one."""
    for b in batches:
        at = b.schema.get_field_index("spans")
        lists = b.column(at)
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        if not len(flat):
            yield b
            continue
        s, e = (np.asarray(flat.field(k)) for k in ("start", "end"))
        row = np.searchsorted(ends, np.arange(len(s)), "right")
        # Every row's words get a stretch of their own, so that ends can be compared across rows.
        base = np.concatenate([[0], np.cumsum(b.column(b.schema.get_field_index("n_words")).to_numpy() + 1)])[row]
        reached = np.maximum.accumulate(e + base)
        head = np.ones(len(s), bool)
        head[1:] = (s + base)[1:] > reached[:-1]
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(s)) - 1
        counts = np.bincount(row[first], minlength=b.num_rows)
        spans = pa.StructArray.from_arrays([pa.array(s[first], pa.int64()), pa.array((reached - base)[last], pa.int64())], names=["start", "end"])
        joined = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
        yield b.set_column(at, "spans", joined)


FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def found(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """Every document of a stored index: doc_id, n_words, removal spans (words from start to before end, merged) and item_ids of the items found."""
    context = index.sparkSession.sparkContext
    parts = []
    for block in blocks(benchmark, window, most):
        sent = context.broadcast(block)
        parts.append(stored(index.mapInArrow(partial(_searched, sent), HITS), "hits"))
        sent.destroy()
    docs = index.select("task", F.inline(F.arrays_zip("row", "doc_id", "n_words")))
    none = docs.select("task", "row", "doc_id", "n_words", *[F.array().cast(kind).alias(n) for n, kind in (("spans", "array<struct<start:long,end:long>>"), ("items", "array<struct<item_id:long>>"))])
    one = reduce(DataFrame.unionByName, parts, none).groupBy("task", "row")
    merged = one.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.select("doc_id", "n_words", "spans", F.transform("items", lambda i: i["item_id"]).alias("items")).mapInArrow(_joined, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, room: int = SHARD, most: int = BLOCK) -> DataFrame:
    """As found, from an index made for the purpose; stored."""
    index = indexed(docs, window, room)
    out = stored(found(index, benchmark, window, most), "contaminated")
    dropped(index)
    return out
