import hashlib
import math
from collections import defaultdict

import pytest

from larder.llm import exact_dedup as X
from larder.llm import queries
from larder.llm.common import stored
from tests.helpers import assert_same
from tests.llm.conftest import ROWS, CLASHING, frame

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(TABLE)].append(r[0])
    return sorted((r[0], max(groups[t]), len(groups[t]), r[0] == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r[1] or "").translate(TABLE)])


@pytest.mark.parametrize("slots", [32768, 1 << 20])
def test_against_brute_force(odd, monkeypatch, slots):
    monkeypatch.setattr(X, "filter_size", lambda rows: slots)
    assert sorted(tuple(r) for r in X.exact_copies(odd).collect()) == brute(ROWS)


def test_a_full_filter_only_moves_more_rows(spark, odd, monkeypatch):
    # Every slot is hit: everything is suspected, the result is the same.
    monkeypatch.setattr(X, "filled_slots", lambda digests, n, least: X.np.full(n // 8, 255, X.np.uint8))
    assert sorted(tuple(r) for r in X.exact_copies(frame(spark, ROWS)).collect()) == brute(ROWS)
    assert sorted(r["doc_id"] for r in X.drop_exact_copies(odd).collect()) == [2, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]


def test_many_rows_take_more_filters_of_the_same_load(spark, monkeypatch):
    assert X.buckets(10**6) == 1 and X.buckets(5 * 10**10) == 2981
    for rows in (10**3, 10**7, 10**9, 5 * 10**10):
        assert X.filter_size(math.ceil(rows / X.buckets(rows))) >= 15 * rows / X.buckets(rows)
    monkeypatch.setattr(X, "MAX_SLOTS", 4096)
    monkeypatch.setattr(X, "SEGMENT", 4096)
    rows = [(i, f"text {i % 900}", "en", "a") for i in range(1000)]
    assert X.buckets(1000) == 4
    marked = X.suspected(X.digested(frame(spark, rows).select("doc_id", "text")))
    marks = {r["doc_id"]: r[X.MAYBE] for r in marked.collect()}
    assert len(marks) == 1000 and all(marks[i] for i in range(1000) if i % 900 < 100)
    assert sum(marks[i] for i in range(100, 900)) < 80
    assert sorted(tuple(r) for r in X.exact_copies(frame(spark, rows)).collect()) == brute(rows)
    assert {r["doc_id"] for r in X.drop_exact_copies(frame(spark, rows)).collect()} == set(range(100, 1000))


def test_filter_finds_all_repeats_and_spares_most_others(spark):
    rows = [(i, f"text {i % 900}", "en", "a") for i in range(1000)]
    marks = {r["doc_id"]: r[X.MAYBE] for r in X.suspected(X.digested(frame(spark, rows).select("doc_id", "text"))).collect()}
    assert all(marks[i] for i in range(1000) if i % 900 < 100)
    assert sum(marks[i] for i in range(100, 900)) < 80


def test_stage_keeps_one_row_of_each_text_and_all_columns(odd):
    kept = X.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert all(r[c] == f"{c}!" for r in rows for c in CLASHING)


def test_repeated_keeper_leaves_one_row(spark):
    rows = [(5, "same", "en", "a"), (5, "same", "en", "a"), (4, "SAME", "en", "a")]
    assert [r["doc_id"] for r in X.drop_exact_copies(frame(spark, rows)).collect()] == [5]


def test_empty_and_ids_missing(empty, no_id):
    assert X.exact_copies(empty).count() == 0 and X.drop_exact_copies(empty).count() == 0
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_copies(no_id).collect()}
    assert got == {(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True)}
    assert X.drop_exact_copies(no_id).count() == 2


def test_query(spark, tiny):
    assert_same(queries.QUERIES["op6_exact_dedup"](spark, tiny), queries.ORACLES["op6_exact_dedup"], tiny)


def test_a_pass_reads_its_own_bucket(spark):
    """Buckets share out the digests, and no file is in two of them."""
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id % 400) AS text")
    digests = stored(X.digested(docs).drop("text"), "digests")
    parts = X.dealt(digests, 7)
    files = [set(p.inputFiles()) for p in parts]
    assert len(parts) == 7 and sum(map(len, files)) == len(set().union(*files))
    ids = [r["doc_id"] for p in parts for r in p.collect()]
    assert sorted(ids) == list(range(500))
