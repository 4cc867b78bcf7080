"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct 5-word shingles; its signature holds SYMBOLS minima of b = 16 bits.
For sets with similarity j a symbol differs with probability 1 - j, so a pair at the threshold
0.85 differs in about 10 of 66 symbols and, but for about one pair in ten thousand, in at most
RADIUS = 21. Other thresholds have a layout of their own (LAYOUTS): at 0.80, that of the pipeline's
stage, 14 chunks of 5 symbols and radius 27, which miss about one pair at the threshold in ten thousand too. The join finds every pair within that distance: a signature is split into 11 chunks of
6 symbols; by the pigeonhole principle two signatures that differ in at most 21 symbols differ in
at most one symbol of some chunk; each chunk is therefore indexed under all its allowed errors,
that is with each symbol in turn left out (66 keys a document). Documents that share a key are
candidates, their signatures' distance is checked, and links are confirmed on the full sets.

What keeps groups of copies from growing quadratically:
* equal sets are one class first (map-side combined), only class representatives are compared;
* a key's documents are first compared with the key's smallest representative alone, which links
  most groups; components of these links are formed;
* of a key's documents in different components all pairs are still due. They are compared in blocks
  inside a task, by signature and then on their full sets; only links that join two components leave
  it. No pair is skipped that could join two components.

Keys spread a group over many partitions; joins are plain equi-joins that Spark can split where
they are skewed; nothing but counts comes to the driver.

Defined cases: null text counts as empty; a text without words has an empty set and is linked with
nothing (its own component, kept); a text of fewer than five words is one shingle; rows that share
a doc_id count as one document: its largest set (by size, then by hash) is taken; null doc_ids
can't be linked and are their own component (null); very long texts are read whole; extra columns
ride along in `drop_near_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import OWN, dropped, small_batches, stored, texts_of
from larder.llm.components import components

WORDS = 5
CHUNKS, CHUNK = 11, 6
SYMBOLS = CHUNKS * CHUNK
#: CHUNKS * (1 + 1) - 1: the largest distance for which some chunk has at most one error.
RADIUS = 2 * CHUNKS - 1
#: 100 * intersection >= SIMILAR * union.
SIMILAR = 85
#: The same for the pipeline's stage.
STAGE = 80
#: Documents and hashes per block of the in-task comparison, so that a task holds two blocks at once; shingles hashed at once.
BLOCK, BLOCK_HASHES, SLICE = 1024, 4_000_000, 4096
#: Up to so many documents a key counts as small.
SMALL = 64


class Layout:
    """Threshold in percent, chunks and symbols a chunk of the signatures that find it, and their hash functions."""

    def __init__(self, percent: int, chunks: int, chunk: int, seed: int):
        self.percent, self.chunks, self.chunk, self.symbols, self.radius = percent, chunks, chunk, chunks * chunk, 2 * chunks - 1
        random = np.random.default_rng(seed)
        self.factors = (random.integers(1, 1 << 31, self.symbols, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.offsets = random.integers(0, 1 << 32, self.symbols, dtype=np.uint64).astype(np.uint32)


THIN = Layout(SIMILAR, CHUNKS, CHUNK, 20240229)
#: percent -> layout.
LAYOUTS = {SIMILAR: THIN, STAGE: Layout(STAGE, 14, 5, 20240301)}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = w[:n].copy()
    for i in range(1, WORDS):
        h = h * _MIX + w[i : i + n]
        h ^= h >> np.uint64(29)
    return np.unique(_mixed(h))


def signature(hashes: np.ndarray, layout: Layout = THIN) -> np.ndarray:
    """The layout's minima, each cut to 16 bits, of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(layout.symbols, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), SLICE):
        np.minimum(least, (x[i : i + SLICE, None] * layout.factors + layout.offsets).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def keys(signatures: np.ndarray, layout: Layout = THIN) -> np.ndarray:
    """For each signature, a key per chunk and left-out symbol."""
    n = len(signatures)
    s = signatures.reshape(n, layout.chunks, layout.chunk).astype(np.uint64)
    out = np.empty((n, layout.chunks, layout.chunk), np.uint64)
    for left_out in range(layout.chunk):
        h = np.broadcast_to((np.arange(layout.chunks, dtype=np.uint64) * np.uint64(layout.chunk) + np.uint64(left_out + 1)) * _MIX, (n, layout.chunks)).copy()
        for i in range(layout.chunk):
            if i != left_out:
                h = _mixed(h + s[:, :, i] + np.uint64(1))
        out[:, :, left_out] = h
    return out.reshape(n, layout.symbols)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a set: a sum and an exclusive or over differently mixed hashes."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(_mixed(s + _MIX)).astype(np.int64)), int(np.bitwise_xor.reduce(_mixed(s * _MIX)).astype(np.int64))


def _signed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        n, h1, h2, signed = [], [], [], []
        for t in texts_of(b):
            s = shingles(t)
            n.append(len(s))
            for out, x in zip((h1, h2), _sums(s), strict=True):
                out.append(x)
            signed.append(signature(s, LAYOUTS[percent]).tobytes() if len(s) else None)
        ids = b.column(b.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(signed, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])


def _keyed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layout = LAYOUTS[percent]
    for b in small_batches(batches, 2048):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, layout.symbols)
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), layout.symbols)
        yield pa.RecordBatch.from_arrays([pa.array(keys(sig, layout).reshape(-1).astype(np.int64)), pa.array(ids)], ["key", "rep"])


def _runs(keyed: DataFrame) -> DataFrame:
    """key, rep and the key's smallest rep, its pivot, of the keys that several rows have.

    Pivots come of partial minima, and rows meet them in a plain join, so Spark can split the rows of a hot key.
    """
    pivots = stored(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n"), "pivots")
    out = stored(keyed.join(pivots, "key").select("key", "rep", "pivot"), "runs")
    dropped(pivots)
    return out


def _near(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with sizes and signatures: those that may be similar."""
    layout = LAYOUTS[percent]
    for b in batches:
        if not b.num_rows:
            continue
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        s, t = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, layout.symbols) for c in ("sig_a", "sig_b"))
        n, m = (col[c].to_numpy() for c in ("n_a", "n_b"))
        keep = ((s != t).sum(axis=1) <= layout.radius) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and hashes of the rows whose set is the wanted one."""
    for b in small_batches(batches):
        made = [shingles(t) for t in texts_of(b)]
        keep = [x == _sums(s)[0] for x, s in zip(b.column(b.schema.get_field_index("h1")).to_pylist(), made, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([s.tobytes() for s in made], pa.binary())], ["rep", "hashes"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s, t = (b.column(b.schema.get_field_index(c)) for c in ("set_a", "set_b"))
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(s, t, strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _left(percent: int, cell: pa.Table) -> pa.Table:
    """Of one key's documents in one or two blocks: links that join components.

    Pairs of different components within the distance are compared on their full sets, here, so
    that a group of many documents just below the threshold gives no rows. Of the large keys that a
    pair shares, it is compared under one only: its first key, if that is large. (Small keys are all
    looked at, but for those with the same documents as another.)
    """
    layout = LAYOUTS[percent]
    rep, n, block = (cell.column(c).to_numpy() for c in ("rep", "n", "block"))
    _, label = np.unique(cell.column("label").to_numpy(), return_inverse=True)
    hashes = cell.column("hashes").to_pylist()
    sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint16).reshape(-1, layout.symbols)
    slot = int((keys(sig[:1], layout)[0].astype(np.int64) == cell.column("key")[0].as_py()).argmax())
    large = cell.column("large")[0].as_py()
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    rows = np.flatnonzero(block == i)
    cols = np.flatnonzero(block == j)
    a, b = [], []
    for r in rows:
        c = cols[(label[cols] != label[r]) & ((rep[cols] > rep[r]) | (i != j))]
        c = c[100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r])]
        differ = sig[c] != sig[r]
        distance = differ.sum(axis=1)
        c, differ = c[near := distance <= layout.radius], differ[near]
        if not len(c):
            continue
        errors = differ.reshape(len(c), layout.chunks, layout.chunk)
        chunk = (errors.sum(axis=2) <= 1).argmax(axis=1)
        first = chunk * layout.chunk + errors[np.arange(len(c)), chunk].argmax(axis=1)
        own = np.frombuffer(hashes[r], np.uint64)
        here = (first == slot) | (not large)
        # Nearest first: once a link is found, others into that component needn't be.
        for k in c[here][np.argsort(distance[near][here], kind="stable")]:
            if label[k] != label[r] and similar(own, np.frombuffer(hashes[k], np.uint64), percent):
                a.append(min(rep[r], rep[k]))
                b.append(max(rep[r], rep[k]))
                label[label == label[k]] = label[r]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """rep and hashes of the representatives among nodes (rep)."""
    wanted = classes.join(nodes.distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "h1")
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(_sets, "rep long, hashes binary")
    return stored(sets.dropDuplicates(["rep"]) if repeated else sets, "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets reach the threshold."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")), docs, classes, repeated)
    of = lambda name: sets.select(F.col("rep").alias(name), F.col("hashes").alias(f"set_{name}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")
    out = stored(joined.mapInArrow(partial(_confirmed, percent), "a long, b long"), "confirmed")
    dropped(sets)
    return out


def _star_links(runs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool, percent: int) -> DataFrame:
    """Links between the first representative of each key and the others."""
    star = runs.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    of = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    near = star.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(partial(_near, percent), "a long, b long")
    pairs = stored(near, "near")
    out = _confirm(pairs, docs, classes, repeated, percent)
    dropped(pairs)
    return out


def _other_links(runs: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool, percent: int) -> DataFrame:
    """Links between documents of one key that are in different components so far."""
    labelled = runs.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    sized = labelled.join(classes.select("rep", "n"), "rep")
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    mixed = sized.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("n_all"), *members).filter("lo <> hi")
    mixed = stored(mixed, "keys")
    # Few documents that share many keys are the rule: of small keys with the same documents one is enough.
    small = mixed.filter(F.col("size") <= SMALL).groupBy("size", "m0", "m1").agg(F.min("key").alias("key"), F.first("n_all").alias("n_all"))
    kept = small.select("key", "size", "n_all").union(mixed.filter(F.col("size") > SMALL).select("key", "size", "n_all"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("n_all") / BLOCK_HASHES)).cast("int")
    rows = stored(sized.join(kept.select("key", blocks.alias("blocks"), (F.col("size") > SMALL).alias("large")), "key"), "mixed")
    dropped(mixed)
    sets = _sets_of(rows.select("rep"), docs, classes, repeated)
    cells = (
        rows.join(classes.select("rep", "sig"), "rep")
        .join(sets, "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "rep", "label", "n", "sig", "hashes", "large", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    out = stored(cells.groupBy("key", "i", "j").applyInArrow(lambda cell: _left(percent, cell), "a long, b long"), "left")
    dropped(sets)
    dropped(rows)
    return out


def near_duplicates(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; percent, the least similarity of a link, is one of LAYOUTS."""
    signed = stored(docs.select("doc_id", "text").mapInArrow(partial(_signed, percent), "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    count = signed.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    repeated = count[0] != count[1]
    known = signed.filter("doc_id IS NOT NULL")
    one = known.groupBy("doc_id").agg(F.max(F.struct("n", "h1", "h2", "sig")).alias("s")).select("doc_id", "s.*") if repeated else known
    classes = stored(one.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keyed = classes.select("rep", "sig").mapInArrow(partial(_keyed, percent), "key long, rep long")
    runs = _runs(keyed)
    links = _star_links(runs, docs, classes, repeated, percent)
    first = components(links)
    more = _other_links(runs, first, docs, classes, repeated, percent)
    labels = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    dropped(runs)
    of_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "rep").alias("component_id"))
    same_set = (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    full = one.filter("n > 0").drop("sig").join(of_class, same_set).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = one.filter("n = 0").union(signed.filter("doc_id IS NULL").select(one.columns)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = stored(full.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
    for table in (signed, classes, links, more, first, labels):
        dropped(table)
    return out


def drop_near_copies(docs: DataFrame, percent: int = STAGE) -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows without an id stay."""
    gone, out = f"{OWN}gone", near_duplicates(docs, percent)
    return docs.join(out.filter("NOT kept").select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")
