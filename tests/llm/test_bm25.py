import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import bm25 as S
from larder.llm import queries
from tests.helpers import assert_same
from tests.llm.conftest import ROWS, frame


def brute(docs, asked, k=10):
    rows = [(i, S.term_counts(t or "")) for i, t in docs]
    n = len(rows)
    mean = max(1.0, sum(sum(c.values()) for _, c in rows) / n)
    df = Counter()
    for _, c in rows:
        df.update(c.keys())
    terms = {}
    for q, t in asked:
        terms.setdefault(q, set()).update(S.term_counts(t or ""))
    out = {}
    for q, words in terms.items():
        hits = []
        for i, c in rows:
            if i is None:
                continue
            norm = S.K1 * (1 - S.B + S.B * sum(c.values()) / mean)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (S.K1 + 1) / (c[t] + norm) for t in words & c.keys())
            if s > 0:
                hits.append((-s, i))
        if hits:
            out[q] = sorted(hits)[:k]
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert set(by) == set(want)
    for q, hits in want.items():
        found = sorted(by[q])
        assert [r for r, _, _ in found] == list(range(1, len(hits) + 1))
        assert [s for _, _, s in found] == pytest.approx([-s for s, _ in hits])
        # Equal scores may differ in the last bit; where they don't, ids are in order.
        for (_, i, s), (t, j) in zip(found, hits, strict=True):
            assert i == j or any(abs(s + u) < 1e-9 and v == i for u, v in hits)


@pytest.mark.parametrize(("shard", "wave"), [(3, 512), (2, 1), (10_000, 512)])
def test_odd_rows(odd, monkeypatch, shard, wave):
    monkeypatch.setattr(S, "STORED_DOCS", shard)
    monkeypatch.setattr(S, "SHARD_DOCS", 2 * shard)
    monkeypatch.setattr(S, "FIRST_WAVE", wave)
    monkeypatch.setattr(S, "WAVE_GROWTH", 1)
    monkeypatch.setattr(S, "QUERY_TERMS", 2000)
    asked = odd.select(F.col("doc_id").alias("query_id"), "text")
    compare(S.search(odd, asked, 5).collect(), brute([r[:2] for r in ROWS], [r[:2] for r in ROWS], 5))


def test_random_corpus(spark, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(S, "SHARD_DOCS", 70)
    monkeypatch.setattr(S, "STORED_DOCS", 40)
    monkeypatch.setattr(S, "BLOCK", 8)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(60_000)]
    docs = []
    for i in range(500):
        n = rng.randrange(1, 200)
        docs.append((i, " ".join(words[rng.randrange(50_000) :][:n]), "en", "s"))
    asked = [(i, t) for i, t, *_ in docs if i % 20 == 0]
    got = S.search(frame(spark, docs), spark.createDataFrame(asked, "query_id long, text string")).collect()
    compare(got, brute([d[:2] for d in docs], asked))


def test_pruned_shard_equals_whole_scores(monkeypatch):
    """Whatever the threshold, a shard returns its best documents that reach it."""
    import numpy as np

    rng = np.random.default_rng(3)
    for few in (1, 40):
        monkeypatch.setattr(S, "FEW", few)
        n, v = 900, 300
        doc = np.repeat(np.arange(n), 30)
        term = np.minimum(rng.zipf(1.3, len(doc)), v) - 1
        pairs = np.unique(np.stack([doc, term]), axis=1)
        tf = rng.integers(1, 6, pairs.shape[1])
        lengths = np.bincount(pairs[0], tf, n)
        by_term = np.lexsort((pairs[0], pairs[1]))
        parts = []
        for low, high in ((0, 100), (100, 101), (101, n)):
            some = by_term[(pairs[0][by_term] >= low) & (pairs[0][by_term] < high)]
            parts.append(S.Part(np.arange(low, high) * 3, lengths[low:high], (pairs[0][some] - low).astype(np.uint16), pairs[1][some], tf[some].astype(np.float32)))
        shard = S.Shard(parts, v, lengths.mean())
        weight = rng.random(v) * 3
        for terms in (np.arange(v), np.arange(5), np.arange(100, 180)):
            dense = np.zeros(v)
            dense[terms] = weight[terms]
            norm = S.K1 * (1 - S.B + S.B * lengths / lengths.mean())
            whole = np.round(np.bincount(pairs[0], dense[pairs[1]] * tf * (S.K1 + 1) / (tf + norm[pairs[0]]), n), S.DIGITS)
            best = np.lexsort((np.arange(n), -whole))[:10]
            best = best[whole[best] > 0]
            for threshold in (0.0, whole[best[-1]] * 0.7, whole[best[-1]], whole[best[0]], whole[best[0]] + 1):
                ids, scores = shard.top(terms, weight[terms], 10, threshold, np.zeros(v))
                want = [(i * 3, whole[i]) for i in best if whole[i] >= threshold]
                got = [(i, s) for i, s in zip(ids, scores, strict=True) if s >= threshold]
                assert [i for i, _ in got] == [i for i, _ in want]
                assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_waves(monkeypatch):
    assert S.waves(0) == [0] and S.waves(7) == [7]
    monkeypatch.setattr(S, "FIRST_WAVE", 2)
    monkeypatch.setattr(S, "WAVE_GROWTH", 3)
    assert S.waves(40) == [2, 8, 32, 40]


def test_empty_tables(spark, odd, empty, no_id):
    asked = odd.select(F.col("doc_id").alias("query_id"), "text")
    assert S.search(empty, asked).count() == 0
    assert S.search(odd, asked.limit(0)).count() == 0
    assert S.search(odd, spark.createDataFrame([(1, None), (2, "nowordlikethis")], "query_id long, text string")).count() == 0
    assert {r["doc_id"] for r in S.search(no_id, spark.createDataFrame([(1, "text here")], "query_id long, text string")).collect()} == {1}


def test_query(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    compare(queries.QUERIES["op10_bm25_top_k"](spark, tiny).collect(), brute(docs, [d for d in docs if d[0] % 50 == 0]))


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(queries.QUERIES["op10_bm25_top_k"](spark, folder), queries.ORACLES["op10_bm25_top_k"], folder)


def test_stored_shards_are_searched_row_by_row(spark, monkeypatch):
    """A task that searches several stored shards gets them one at a time: a batch of them all is as large as its share of the index."""
    usual = spark.conf.get(S.BATCH_ROWS)
    searching = S._searching

    def watched(shared, mean_length, k):
        search = searching(shared, mean_length, k)

        def each(batches):
            def one():
                for b in batches:
                    assert b.num_rows == 1, b.num_rows
                    yield b

            return search(one())

        return each

    monkeypatch.setattr(S, "_searching", watched)
    docs = frame(spark, [(i, f"w{i % 7} x{i % 5} y{i}", "en", "web") for i in range(200)]).repartition(16)
    found = S.search(docs, docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))
    assert found.filter("rank = 1").count() == 4 and spark.conf.get(S.BATCH_ROWS) == usual


def test_common_words_are_not_added_posting_by_posting(monkeypatch):
    """Of a query as long as a document most postings are those of common words: they come as a product, or for the few documents that block maxima leave."""
    import numpy as np

    monkeypatch.setattr(S, "DENSE", 48)
    monkeypatch.setattr(S, "MIDDLE", 100, raising=False)
    rng = np.random.default_rng(11)
    n, v = 3000, 2500
    share = np.minimum(0.5, 5 / (np.arange(v) + 8))
    term, doc = np.nonzero(rng.random((v, n)) < share[:, None])
    tf = rng.integers(1, 4, len(doc))
    lengths, size = np.bincount(doc, tf, n), np.bincount(term, minlength=v)
    idf = np.log(1 + (n - size + 0.5) / (size + 0.5))
    impact = tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * lengths / lengths.mean())[doc])
    added, scored = [], []
    add, full = S.Shard._add, S.Shard.full
    monkeypatch.setattr(S.Shard, "_add", lambda self, total, terms, weights: (added.append(size[terms].sum()), add(self, total, terms, weights))[1])
    monkeypatch.setattr(S.Shard, "full", lambda self, docs, *more: (scored.append(len(docs)), full(self, docs, *more))[1])
    shard = S.Shard([S.Part(np.arange(n), lengths, doc, term, tf.astype(np.float32))], v, lengths.mean())
    threshold, whole = {}, []
    for _ in range(2):
        for q in range(0, n, 100):
            terms = np.unique(term[doc == q])
            whole.append(size[terms].sum())
            ids, scores = shard.top(terms, idf[terms], 10, threshold.get(q, 0.0), np.zeros(v))
            want = np.round(np.bincount(doc, np.where(np.isin(term, terms), idf[term], 0) * impact, n), S.DIGITS)
            best = np.lexsort((np.arange(n), -want))[:10]
            assert ids.tolist() == best.tolist() and scores.tolist() == pytest.approx(want[best].tolist())
            threshold[q] = float(scores[-1])
    assert sum(added) < sum(whole) / 3, sum(added) / sum(whole)
    assert sum(scored) < 25 * len(whole)
