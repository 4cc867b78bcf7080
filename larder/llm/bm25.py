"""Exact top-k search: BM25 over a stored, sharded inverted index with block-max dynamic pruning.

The corpus is tokenised once. Every task turns its documents into shards of bounded size and stores
them: terms, and for each its postings (document and count). Global statistics, the number and mean
length of documents and the document frequencies, are summed from the stored shards, so the scores of
all shards are on one scale.

Queries are handled in blocks of bounded size (QUERY_TERMS term weights), packed by the executors,
and broadcast one at a time; each block passes over the stored index. Within a shard documents are
ordered by length, so that blocks of them have like impacts. Queries with many terms, as whole documents are, have lists of three kinds.
The longest lists, with words that most queries have too, are added for a group of queries
at once, as a product of matrices. The many short ones, with rare words, are added posting by posting.
The lists between these aren't added at first: a block's largest impact is known for each, and
documents whose partial score and these block maxima don't reach the threshold drop out (the k-th best score so
far, or the k-th best partial sum). The rest, some in a hundred, get what the middle lists give them, which raises
the threshold, and the few that reach it are scored in full. That is the block-max WAND bound, taken over
lists and blocks at once, so that it runs as array operations.

Thresholds are carried from shard to shard within a task and, in a large index, from wave to wave:
the first wave has FIRST_WAVE shards, each further one WAVE_GROWTH times as many as all before, so a query
gets some k hits a wave and not k hits from every task. Merging the lists gives the exact top k. Documents are never
brought to the driver, and of the queries one packed block at a time.

The work grows with queries times matching postings: pruning lowers it but not its order.

Defined cases: null or empty texts have no terms, are never found and find nothing; documents
count one for one, equal rows too; rows of queries with one id are one query with all their terms;
scores are rounded to 9 digits, equal ones are ordered by doc_id; a term counts once in a query, however often it stands there;
fewer than k matching documents give fewer rows; rows without doc_id count for the statistics but
aren't found; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import dropped, small_batches, stored, texts_of

K1, B, TOP = 1.2, 0.75, 10
#: Documents (65 536 at most) and postings of a stored shard, and of those that a task puts together to search them.
STORED_DOCS, STORED_POSTINGS, SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000, 16_384, 4_000_000
#: Documents of a block, queries of a group, term weights of a block of queries, tasks whose lists are merged first.
BLOCK, GROUP, QUERY_TERMS, FAN_IN = 8, 64, 2_000_000, 256
#: Stored shards in the first wave, and in each further one for each shard before it.
FIRST_WAVE, WAVE_GROWTH = 32, 31
#: So many of the longest lists are added by a product of matrices, so many next ones only for documents that their block maxima leave
#: (both with one in SPARSE documents at least); FEW candidates are scored in full.
DENSE, MIDDLE, SPARSE, FEW = 384, 640, 32, 16
#: Documents that a task of the search has at least, where there are more tasks than cores.
TASK_DOCS = 1 << 15

#: Scores are rounded to so many digits, and equal from there on.
DIGITS, UNIT = 9, 2e-9
#: Any match scores more.
LEAST = 1e-30

WORD = re.compile(r"[^\W_]+")


def term_counts(text: str) -> dict[str, int]:
    return Counter(WORD.findall(text.lower()))


class _Hashes(dict):
    """Word -> its hash, for the words met first."""

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word) >> 1
        if len(self) < 200_000 and len(word) <= 40:
            self[word] = out
        return out


_HASHES = _Hashes()


def _hashed(words) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.int64)


def _bytes(values, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    return _bytes(values, next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w))


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u1")


INDEX = "shard long, docs long, words long, ids binary, named binary, lengths binary, terms binary, sizes binary, post_doc binary, post_tf binary"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of one task's documents: per term, in the order of hashes, the documents it is in and how often."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list = []
    lengths: list[int] = []
    terms: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    docs = words = postings = 0

    def out() -> pa.RecordBatch:
        sizes = [len(t) for t in terms]
        term = np.concatenate([np.empty(0, np.int64), *terms])
        tf = np.concatenate([np.empty(0, np.int32), *counts])
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        row = {
            "shard": (task << 24) + made,
            "docs": docs,
            "words": words,
            "ids": _bytes([i or 0 for i in ids], "<i8"),
            "named": _bytes([i is not None for i in ids], "?"),
            "lengths": _bytes(lengths, "<i8"),
            "terms": _bytes(term[first], "<i8"),
            "sizes": _narrow(np.diff(first, append=len(term))),
            "post_doc": _narrow(doc),
            "post_tf": _narrow(tf),
        }
        kinds = [pa.int64()] * 3 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    for b in small_batches(batches):
        for doc_id, t in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), texts_of(b), strict=True):
            found = term_counts(t)
            docs += 1
            if not found:
                continue
            n = np.fromiter(found.values(), np.int32, len(found))
            ids.append(doc_id)
            lengths.append(int(n.sum()))
            terms.append(_hashed(found))
            counts.append(n)
            words, postings = words + lengths[-1], postings + len(n)
            if len(ids) >= STORED_DOCS or postings >= STORED_POSTINGS:
                yield out()
                made, docs, words, postings = made + 1, 0, 0, 0
                for x in (ids, lengths, terms, counts):
                    x.clear()
    if docs:
        yield out()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term and the number of documents that have it, for each shard."""
    for b in batches:
        for terms, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            term = np.frombuffer(terms, "<i8")
            n = _wide(sizes, len(term)).astype(np.int64)
            for i in range(0, len(term), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(term[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["term", "n"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        ids = b.column(b.schema.get_field_index("query_id")).to_pylist()
        terms = [_hashed(term_counts(t)) for t in texts_of(b)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(t) for t in terms])), pa.array(np.concatenate([np.empty(0, np.int64), *terms]))], ["query_id", "term"])


PACKED = ("ids", "start", "vocabulary", "terms", "weights")


def _packed(rows: pa.Table) -> pa.Table:
    """A block's term weights as one row of bytes, ordered by query and term; terms are places in a sorted vocabulary."""
    ids, terms, weights = (rows.column(c).to_numpy() for c in ("query_id", "term", "weight"))
    order = np.lexsort((terms, ids))
    ids, start = np.unique(ids[order], return_index=True)
    vocabulary, terms = np.unique(terms[order], return_inverse=True)
    blobs = _bytes(ids, "<i8"), _bytes(np.append(start, len(order)), "<i8"), _bytes(vocabulary, "<i8"), _bytes(terms, "<i4"), _bytes(weights[order], "<f8")
    return pa.table([rows.column("block").slice(0, 1), *[pa.array([x], pa.binary()) for x in blobs]], ["block", *PACKED])


class Queries:
    """A block of queries: ids, and for each its terms, as places in a sorted vocabulary, with weights and a threshold."""

    def __init__(self, ids: bytes, start: bytes, vocabulary: bytes, terms: bytes, weights: bytes, known: dict[int, float]):
        self.ids, self.start = np.frombuffer(ids, "<i8"), np.frombuffer(start, "<i8").tolist()
        self.vocabulary, self.terms, self.weights = np.frombuffer(vocabulary, "<i8"), np.frombuffer(terms, "<i4"), np.frombuffer(weights, "<f8")
        self.threshold = [known.get(i, 0.0) for i in self.ids.tolist()]

    def groups(self) -> Iterator[list[tuple[np.ndarray, np.ndarray, float]]]:
        """Terms, weights and threshold of the queries, a group at a time."""
        for i in range(0, len(self.ids), GROUP):
            yield [(self.terms[a:z], self.weights[a:z], t) for a, z, t in zip(self.start[i : i + GROUP], self.start[i + 1 : i + GROUP + 1], self.threshold[i : i + GROUP], strict=False)]


class Part(NamedTuple):
    """Some documents' postings of the terms of a block of queries, ordered by term."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


class Shard:
    """An inverted index of the parts' documents, for the terms of a block of queries. Uses up the list of parts."""

    def __init__(self, parts: list[Part], n_terms: int, mean_length: float):
        lengths = np.concatenate([p.lengths for p in parts]).astype(float)
        doc_ids = np.concatenate([p.doc_ids for p in parts])
        n = len(lengths)
        # Documents of like length share a block. Their first documents have the first places, then come all second ones,
        # so that a block is a column of BLOCK rows; places that are left over have no postings and stand for document n.
        self.n_blocks = (n - 1) // BLOCK + 1
        self.width = self.n_blocks * BLOCK
        by_length, number = np.argsort(lengths, kind="stable"), np.arange(n)
        place = np.empty(n, np.int32)
        place[by_length] = number % BLOCK * self.n_blocks + number // BLOCK
        #: By place: the number in the parts' order, the id, and what the length adds to tf.
        self.origin, self.doc_ids, self.norm = np.full(self.width, n), np.zeros(self.width, np.int64), np.ones(self.width)
        self.origin[place], self.doc_ids[place], self.norm[place] = number, doc_ids, K1 * (1 - B + B * lengths / mean_length)
        size = np.zeros(n_terms, np.int64)
        for p in parts:
            size += np.bincount(p.term, minlength=n_terms)
        # The longest lists are rows by place, the next ones columns, with the largest impact of each block; row: which of these a term is.
        common = np.argsort(-size, kind="stable")[: DENSE + MIDDLE]
        common = common[size[common] * SPARSE >= n]
        self.row = np.full(n_terms, -1, np.int16)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common[:DENSE]), self.width), np.float32)
        self.middle = np.zeros((self.width, len(common[DENSE:])), np.float32)
        # The other lists by term, a posting one number: the place above, the impact's bits below.
        self.size = np.where(self.row < 0, size, 0)
        self.start, self.asked = np.cumsum(self.size) - self.size, np.zeros(n_terms, bool)
        self.post = np.empty(int(self.size.sum()), "<i8")
        # All lists by document.
        total = int(size.sum())
        self.doc_term, self.doc_tf = np.empty(total, np.int32), np.empty(total, np.result_type(*[p.tf for p in parts]))
        doc_size, free, docs, at, norm = np.zeros(n + 1, np.int64), self.start.copy(), 0, 0, self.norm.astype("<f4")
        parts.reverse()
        while parts:
            p = parts.pop()
            n_docs, m = len(p.doc_ids), len(p.doc)
            by_doc = np.argsort(p.doc, kind="stable")
            self.doc_term[at : at + m], self.doc_tf[at : at + m] = p.term[by_doc], p.tf[by_doc]
            del by_doc
            doc_size[docs : docs + n_docs] = np.bincount(p.doc, minlength=n_docs)
            doc, row, tf = place[docs : docs + n_docs][p.doc], self.row[p.term], p.tf.astype("<f4")
            impact = tf * (K1 + 1) / (tf + norm[doc])
            head, middle, rest = (np.flatnonzero(x) for x in ((row >= 0) & (row < DENSE), row >= DENSE, row < 0))
            self.dense[row[head], doc[head]] = impact[head]
            self.middle[doc[middle], row[middle] - DENSE] = impact[middle]
            # Within a part a term's postings are neighbours: they go behind those of the parts before it.
            term = p.term[rest]
            own = np.bincount(term, minlength=n_terms)
            self.post[(free - (np.cumsum(own) - own))[term] + np.arange(len(term))] = doc[rest].astype("<i8") << 32 | impact[rest].view("<u4")
            free += own
            docs, at = docs + n_docs, at + m
        self.doc_start = np.concatenate(([0], np.cumsum(doc_size)))
        self.block_max = self.middle.reshape(BLOCK, self.n_blocks, self.middle.shape[1]).max(axis=0)

    def full(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        out = np.empty(len(docs))
        scratch[terms], self.asked[terms] = weights, True
        for i in range(0, len(docs), 2048):
            some = docs[i : i + 2048]
            origin = self.origin[some]
            lists = [slice(a, z) for a, z in zip(self.doc_start[origin].tolist(), self.doc_start[origin + 1].tolist(), strict=True)]
            term, tf = (np.concatenate([c[x] for x in lists]) for c in (self.doc_term, self.doc_tf))
            hit = np.flatnonzero(self.asked.take(term))
            doc = np.searchsorted(np.cumsum([x.stop - x.start for x in lists]), hit, "right")
            tf = tf[hit].astype(float)
            out[i : i + 2048] = np.bincount(doc, scratch[term[hit]] * (tf * (K1 + 1) / (tf + self.norm[some][doc])), len(some))
        scratch[terms], self.asked[terms] = 0, False
        return out

    def _add(self, total: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Adds what these lists give to each document's total."""
        n = self.size[terms]
        at = np.repeat(self.start[terms] + n - np.cumsum(n), n)
        at += np.arange(len(at))
        post = self.post.take(at)
        given = np.repeat(weights.astype(np.float32), n)
        given *= post.view("<f4")[::2]
        np.add.at(total, post >> 32, given)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, threshold: float, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tops, of one query."""
        return self.tops([(terms, weights, threshold)], k, scratch)[0]

    def tops(self, asked: list[tuple[np.ndarray, np.ndarray, float]], k: int, scratch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores, for each query (terms, weights, threshold), of the documents that may be among its best k:
        those of the shard's best that reach the threshold, and perhaps some that don't."""
        rows = [self.row[terms] for terms, _, _ in asked]
        by_row = np.zeros((len(asked), len(self.dense) + self.middle.shape[1]), np.float32)
        for into, row, (_, weights, _) in zip(by_row, rows, asked, strict=True):
            into[row[row >= 0]] = weights[row >= 0]
        head, middle = np.split(by_row, [len(self.dense)], axis=1)
        # The longest lists are added as they are, of the next ones what they can give at most, by block.
        totals, bounds = head @ self.dense, middle @ self.block_max.T
        out = []
        for total, bound, own, row, (terms, weights, threshold) in zip(totals, bounds, middle, rows, asked, strict=True):
            self._add(total, terms[row < 0], weights[row < 0])
            out.append(self._reaching(total, bound, own, terms, weights, k, threshold, scratch))
        return out

    def _reaching(self, total: np.ndarray, bound: np.ndarray, middle: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, threshold: float, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tops of one query, from its sums over all but the middle lists and the bounds of these."""
        # Sums are rounded to 32 bits until candidates are scored in full: thresholds give way by as much.
        slack = 1 - 4e-7 * (len(terms) + 16)

        def kth(sums: np.ndarray) -> float:
            """With k partial sums above it, a threshold is certain."""
            return float(np.partition(sums, len(sums) - k)[len(sums) - k]) * slack - UNIT if len(sums) > k else 0.0

        floor = threshold * slack - UNIT if threshold > 0 else kth(total)
        docs = np.flatnonzero((total.reshape(BLOCK, -1) + bound).ravel() >= max(floor, LEAST))
        if len(docs) > FEW:
            sums = total[docs] + self.middle.take(docs, axis=0) @ middle
            docs = docs[sums >= max(floor, kth(sums), LEAST)]
        if not len(docs):
            return np.empty(0, np.int64), np.empty(0)
        whole = self.full(docs, terms, weights, scratch)
        ids, scores = self.doc_ids[docs[whole > 0]], np.round(whole[whole > 0], DIGITS)
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _searching(shared, mean_length: float, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(*shared.value)
        n_terms = len(q.vocabulary)
        scratch = np.zeros(n_terms)
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q.ids)
        parts: list[Part] = []
        size = [0, 0]

        def run() -> None:
            shard = Shard(parts, n_terms, mean_length)
            for i, (found, scores) in enumerate(itertools.chain.from_iterable(shard.tops(some, k, scratch) for some in q.groups())):
                if len(found):
                    if best[i] is not None:
                        found, scores = np.concatenate((best[i][0], found)), np.concatenate((best[i][1], scores))
                    order = np.lexsort((found, -scores))[:k]
                    best[i] = found[order], scores[order]
                    if len(order) == k:
                        q.threshold[i] = max(q.threshold[i], float(scores[order[-1]]))
            size[:] = 0, 0

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i].as_buffer() for j, c in enumerate(b.schema.names)}
                term = np.frombuffer(row["terms"], "<i8")
                if not len(term):
                    continue
                at = np.minimum(np.searchsorted(q.vocabulary, term), n_terms - 1).astype(np.int32)
                asked = q.vocabulary[at] == term
                n = _wide(row["sizes"], len(term)).astype(np.int64)
                doc, tf = (_wide(row[c], int(n.sum())) for c in ("post_doc", "post_tf"))
                mine = np.repeat(asked, n) & np.frombuffer(row["named"], "?")[doc]
                # Copies: views would keep the whole Arrow batch.
                part = Part(np.frombuffer(row["ids"], "<i8").copy(), np.frombuffer(row["lengths"], "<i8").copy(), doc[mine], np.repeat(at, n)[mine], tf[mine])
                if parts and (size[0] + len(part.doc_ids) > SHARD_DOCS or size[1] + len(part.doc) > SHARD_POSTINGS):
                    run()
                parts.append(part)
                size[0] += len(part.doc_ids)
                size[1] += len(part.doc)
                del row, term, at, asked, n, doc, tf, mine, part
            del b
        if parts:
            run()
        rows = [i for i, x in enumerate(best) if x is not None]
        task = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.ids[rows]), pa.array([task] * len(rows), pa.int64()), pa.array([best[i][0].tolist() for i in rows], pa.list_(pa.int64())), pa.array([best[i][1].tolist() for i in rows], pa.list_(pa.float64()))],
            ["query_id", "part", "ids", "scores"],
        )

    return search


def _merged(k: int):
    def merge(lists: pa.Table) -> pa.Table:
        ids = np.concatenate([np.asarray(x, np.int64) for x in lists.column("ids").to_pylist()])
        scores = np.concatenate([np.asarray(x) for x in lists.column("scores").to_pylist()])
        best = np.lexsort((ids, -scores))[:k]
        return pa.table({"query_id": lists.column("query_id").slice(0, 1), "ids": pa.array([ids[best].tolist()], pa.list_(pa.int64())), "scores": pa.array([scores[best].tolist()], pa.list_(pa.float64()))})

    return merge


_LISTS = "query_id long, ids array<long>, scores array<double>"


def _best(lists: DataFrame, k: int) -> DataFrame:
    once = lists.groupBy("query_id", "part").applyInArrow(lambda key, t: _merged(k)(t), _LISTS)
    return once.groupBy("query_id").applyInArrow(lambda key, t: _merged(k)(t), _LISTS)


def waves(shards: int) -> list[int]:
    """How many of the stored shards have been searched after each wave."""
    out = [min(shards, FIRST_WAVE)]
    while out[-1] < shards:
        out.append(min(shards, out[-1] * (1 + WAVE_GROWTH)))
    return out


#: Rows that Spark puts into an Arrow batch, rows of a file, bytes of files that one task reads.
BATCH_ROWS, FILE_ROWS, TASK_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxRecordsPerFile", "spark.sql.files.maxPartitionBytes"


def _stored_under(settings: dict[str, str], df: DataFrame, name: str) -> DataFrame:
    conf = df.sparkSession.conf
    usual = {c: conf.get(c) for c in settings}
    for c, v in settings.items():
        conf.set(c, v)
    try:
        return stored(df, name)
    finally:
        for c, v in usual.items():
            conf.set(c, v)


def _stored_by_shard(lists: DataFrame, name: str) -> DataFrame:
    """stored, for a table made of the index: a row of it is megabytes, so it goes to Python by the row, not a task's rows in one batch,
    and files of few rows go to tasks by ones and twos, so that tasks have like shares of a wave."""
    return _stored_under({BATCH_ROWS: "1", TASK_BYTES: "32m"}, lists, name)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the best k documents of each query (query_id, text)."""
    spark = docs.sparkSession
    index = _stored_under({FILE_ROWS: "4"}, docs.select("doc_id", "text").mapInArrow(_indexed, INDEX), "index")
    whole = index.agg(F.count("*").alias("shards"), F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n, mean_length = whole["docs"] or 0, max(1.0, (whole["words"] or 0) / max(1, whole["docs"] or 0))
    # Stored, so that both sides of the join below are plain exchanges: Spark splits a word that very many queries have.
    counts = _stored_by_shard(index.select("terms", "sizes").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")), "counts")
    df = F.col("df").cast("double")
    terms = queries.filter("query_id IS NOT NULL").select("query_id", "text").mapInArrow(_query_terms, "query_id long, term long").distinct()
    weighed = stored(terms.join(counts, "term").select("query_id", "term", F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5)).alias("weight")), "weights")
    dropped(counts)
    blocks = max(1, math.ceil(weighed.count() / QUERY_TERMS))
    numbered = weighed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    packed = stored(numbered.groupBy("block").applyInArrow(lambda key, t: _packed(t), "block long, " + ", ".join(f"{c} binary" for c in PACKED)), "queries")
    dropped(weighed)
    # Shards come to a wave by the hash of their number.
    share = F.pmod(F.xxhash64("shard"), F.lit(1 << 40)) / float(1 << 40)
    ends = [0.0] + [w / max(1, whole["shards"]) for w in waves(whole["shards"])]
    found: list[DataFrame] = []
    for i in range(blocks):
        row = packed.filter(F.col("block") == i).first()
        if row is None:
            continue
        known: dict[int, float] = {}
        mine: list[DataFrame] = []
        for low, high in zip(ends, ends[1:], strict=False):
            if mine:
                # A block has no more queries than term weights; of each comes one number.
                kth = _best(_union(mine), k).filter(F.size("scores") == k).select("query_id", F.element_at("scores", -1).alias("score")).collect()
                known = {r["query_id"]: r["score"] for r in kth}
            shared = spark.sparkContext.broadcast((*(bytes(row[c]) for c in PACKED), known))
            some = index if len(ends) == 2 else index.filter((share >= low) & (share < high))
            some = some.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(n * (high - low) / TASK_DOCS)))
            lists = some.drop("docs", "words", "shard").mapInArrow(_searching(shared, mean_length, k), "query_id long, part long, ids array<long>, scores array<double>")
            mine.append(_stored_by_shard(lists, "found"))
            shared.destroy()
        found += mine
    dropped(index)
    dropped(packed)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    best = stored(_best(_union(found), k), "best")
    for lists in found:
        dropped(lists)
    places = best.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "hit"))
    return places.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.ids").alias("doc_id"), F.col("hit.scores").alias("score"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
