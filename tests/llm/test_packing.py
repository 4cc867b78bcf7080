import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import packing as K
from larder.llm import queries
from larder.llm.tokens import default_vocabulary
from tests.llm.conftest import ROWS


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def verify(rows, texts, ids_of, capacity=2048):
    """Every document's pieces rebuild it; sequences are gapless and hold no more than they may. Returns their number."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    counts = defaultdict(int)
    for doc_id, text in texts:
        counts[doc_id] += 1
    for doc_id, text in texts:
        ids = ids_of(text)
        n = math.ceil(len(ids) / capacity)
        pieces = [r for r in by_doc[doc_id]]
        assert len(pieces) == n * counts[doc_id]
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == capacity or r["piece"] == 0
    return len(by_seq)


def test_odd_rows(odd, empty, ids_of):
    rows = K.packed(odd).collect()
    n = verify(rows, [(r[0], r[1]) for r in ROWS], ids_of)
    assert n == math.ceil(sum(len(ids_of(r[1])) for r in ROWS) / 2048)
    assert K.packed(empty).count() == 0


def test_islands_meet_again(odd, ids_of, monkeypatch):
    monkeypatch.setattr(K, "ISLAND", 3)
    rows = K.packed(odd).collect()
    verify(rows, [(r[0], r[1]) for r in ROWS], ids_of)


@pytest.mark.parametrize("lengths", [(1100,), (700, 800, 900), (1100, 300, 250, 20)], ids=str)
def test_islands_stay_bounded(spark, monkeypatch, lengths):
    """Whatever bins can't be filled: no level puts more than a few times ISLAND pieces together, and each is packed once."""
    monkeypatch.setattr(K, "ISLAND", 40)
    n = 1500
    cut = spark.createDataFrame([(i, 0, 0, lengths[i % len(lengths)], i, (i * 2654435761) % (1 << 61)) for i in range(n)], K.PIECE + ", salt long")
    monkeypatch.setattr(K, "pieces", lambda docs, vocabulary, capacity: cut)
    rows = K.packed(cut).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    islands, bins = defaultdict(int), defaultdict(int)
    for r in rows:
        islands[r["sequence_id"] >> 24] += 1
        bins[r["sequence_id"]] += r["length"]
    assert max(islands.values()) < 3 * 40 and max(bins.values()) <= 2048
    least = n if lengths == (1100,) else sum(bins.values()) / 2048
    assert len(bins) <= 1.35 * least + 1


def test_crossover_works_without_well_filled_bins():
    size = [1000, 900, 800, 1100, 950, 850] * 20
    packing = K.evolve(size, 2048, 3)
    assert sorted(i for b in packing for i in b) == list(range(len(size))) and len(packing) <= len(K.evolve(size, 2048, 3, generations=0))


def sizes(seed, n=600):
    rng = random.Random(seed)
    return [min(2047, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_evolution_packs_every_item_once(seed):
    size = sizes(seed)
    first = K.evolve(size, 2048, seed, generations=0)
    best = K.evolve(size, 2048, seed)
    for packing in (first, best):
        assert sorted(i for b in packing for i in b) == list(range(len(size)))
        assert all(sum(size[i] for i in b) <= 2048 for b in packing)
    assert len(best) <= len(first) <= math.ceil(sum(size) / 2048) + 2
    again = K.evolve(size, 2048, seed, start=first, immigrants=[[size[i] for i in b] for b in first[:5]])
    assert len(again) <= len(first)


def test_crossover_injects_whole_bins():
    size = [60, 40, 50, 50, 30, 70]
    receiver = K._Bins(size, 100)
    for b in ([0, 4], [1, 2], [3], [5]):
        receiver.add(b)
    child = K.crossover(receiver, [[0, 1], [2, 3]])
    bins = sorted(sorted(b) for b in child.bins())
    assert [0, 1] in bins and [2, 3] in bins and sorted(i for b in bins for i in b) == list(range(6)) and [4, 5] in bins


def test_immigrants_become_own_bins():
    assert K._instances([[5, 3], [5, 5], [9]], [5, 3, 5]) == [[0, 1]] or K._instances([[5, 3], [5, 5], [9]], [5, 3, 5]) == [[2, 1]]
    assert K.evolve([], 10, 1) == []


def test_best_fit_beats_first_fit_on_harder_items():
    rng = random.Random(4)
    size = [rng.randrange(500, 1100) for _ in range(200)]
    packing = K.evolve(size, 2048, 1, generations=12)
    assert len(packing) <= len(K.evolve(size, 2048, 1, generations=0))


def test_query(spark, tiny, ids_of):
    rows = queries.QUERIES["op3_packing"](spark, tiny).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    n = verify(rows, texts, ids_of)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
