"""The FM-index against naive searches, decontamination against a plain version over word lists."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import decontamination as M
from larder.llm import fm_index, queries
from tests.helpers import assert_same
from tests.llm.conftest import LONG, frame


def test_query_equals_sql(spark, tiny):
    assert_same(queries.QUERIES["op11_decontamination"](spark, tiny), queries.ORACLES["op11_decontamination"], tiny)


def symbols(sequences):
    return np.concatenate([np.array([*s, 0], np.int64) for s in sequences])


@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_index_finds_what_a_scan_finds(sequences, patterns):
    text = symbols(sequences)
    search = fm_index.Searcher(fm_index.Index.of(text))
    most = max(text.max(), 0)
    rows = np.array([[0] * (5 - len(p)) + [s if s <= most else -1 for s in p] for p in patterns], np.int64)
    for p, lo, hi in zip(patterns, *search.ranges(rows), strict=True):
        places = sorted(search.places(np.arange(lo, hi)).tolist())
        assert places == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]


def test_suffix_order_of_long_repeats():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 50, 700).tolist()
    text = symbols([passage, [1] * 300, passage[100:], [], [1] * 299, passage, rng.integers(1, 9, 500).tolist()])
    ends = np.flatnonzero(text == 0)
    key = lambda p: (*[(s, 0) for s in text[p : ends[np.searchsorted(ends, p)]].tolist()], (0, p + int(ends[np.searchsorted(ends, p)] - p)))
    assert fm_index.suffix_order(text).tolist() == sorted(range(len(text)), key=key)


def plain_version(docs, items, window):
    """A row for each document: id, words, merged spans and item ids."""
    wanted = {}
    for item_id, text in items:
        w = M.words(text)
        for i in range(max(min(1, len(w)), len(w) - window + 1)):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = M.words(text)
        hit, ids = [False] * len(w), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wanted:
                    hit[i : i + n] = [True] * n
                    ids |= wanted[k]
        spans, at = [], 0
        while at < len(w):
            if hit[at]:
                end = at
                while end < len(w) and hit[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((doc_id, len(w), spans, sorted(ids, key=str)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], sorted(r["items"], key=str)) for r in df.collect()), key=str)


ITEMS = [(1, "One two, three FOUR five six"), (2, "two three four"), (3, "six"), (4, None), (5, "  .,; "), (None, "five six seven"), (2, "ninety"), (7, "Straße ÄÖ größe x"), (8, "w0 w2916 w829 w3745 w1658")]


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "kept!") for i in items], "item_id long, text string, window string").repartition(2)


@pytest.mark.parametrize(("window", "room", "most"), [(3, 8, 2), (3, 64, 1), (4, 1000, 100), (10, fm_index.MOST, 100)])
def test_equals_a_plain_version(spark, odd, no_id, window, room, most):
    rng = random.Random(window)
    pool = "one two three four five six seven eight".split()
    made = [(100 + i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60))), "en", "a") for i in range(40)]
    for docs in (odd, no_id, frame(spark, made)) if room > 8 else (no_id, frame(spark, made)):
        expected = plain_version([(r.doc_id, r.text) for r in docs.collect()], ITEMS, window)
        assert result(M.contaminated(docs, benchmark(spark, ITEMS), window, room, most)) == expected


def test_a_document_longer_than_a_shard(spark):
    items = [(1, " ".join(LONG.split()[1020:1030])), (2, " ".join(LONG.split()[-4:]))]
    docs = frame(spark, [(1, LONG, "en", "a"), (2, "short", "en", "a")])
    found = M.contaminated(docs, benchmark(spark, items), room=1024)
    assert result(found) == plain_version([(1, LONG), (2, "short")], items, M.WINDOW)


def test_one_index_serves_several_benchmarks(spark, odd):
    index = M.indexed(odd, 3)
    for items in (ITEMS[:2], ITEMS[5:], []):
        assert result(M.found(index, benchmark(spark, items) if items else benchmark(spark, ITEMS).limit(0), 3)) == plain_version([(r.doc_id, r.text) for r in odd.collect()], items, 3)


def test_empty_tables(spark, empty):
    assert M.contaminated(empty, benchmark(spark, ITEMS)).collect() == []


def test_limits(spark, odd):
    with pytest.raises(ValueError):
        M.indexed(odd, 10, 10)
    with pytest.raises(ValueError):
        fm_index.suffix_order(np.zeros(fm_index.MOST + 1, np.int64))
