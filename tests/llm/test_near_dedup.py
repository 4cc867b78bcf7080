import random
import re

import numpy as np
import pytest

from larder.llm import near_dedup as N
from larder.llm import queries
from larder.llm.components import components
from tests.llm.conftest import CLASHING, ROWS, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(TABLE))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def family(seed, n, words, change):
    """Copies of copies, each with some words changed: a chain of links."""
    rng = random.Random(seed)
    text = [f"s{seed}w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(text)
        for _ in range(change):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def corpus():
    texts = family(1, 30, 120, 1) + family(2, 30, 300, 3) + family(3, 15, 12, 1) + family(4, 40, 80, 2)
    base = family(5, 1, 200, 0)[0].split()
    rng = random.Random(9)
    for _ in range(40):  # a hot group about the threshold, all near one base
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [texts[0].upper(), texts[40] + " end", "", "a b", "A  b"]
    rng.shuffle(texts)
    return [(100 + i, t, "en", "s") for i, t in enumerate(texts)]


def test_odd_rows(odd):
    got = N.near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and result(got) == brute(ROWS)
    assert got.count() == 14  # a repeated id is one document


@pytest.mark.parametrize("block, small", [(1024, 64), (7, 5)])
def test_against_brute_force(spark, monkeypatch, block, small):
    rows = corpus()
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "SMALL", small)
    assert result(N.near_duplicates(frame(spark, rows))) == brute(rows)


def test_stage(odd, empty, no_id):
    kept = N.drop_near_copies(odd)
    assert kept.columns == odd.columns and all(r[c] == f"{c}!" for r in kept.collect() for c in CLASHING)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in brute(ROWS).items() if k}
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_copies(empty).count() == 0
    assert N.drop_near_copies(no_id).count() == 3


def test_same_id_with_different_texts(spark):
    rows = [(1, "a b c d e f g", "en", "s"), (1, "a b", "en", "s"), (2, "a b c d e f g", "en", "s")]
    assert result(N.near_duplicates(frame(spark, rows))) == {1: (3, 1, True), 2: (3, 1, False)}


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    for distance in range(N.RADIUS + 1):
        a = rng.integers(0, 1 << 16, (50, N.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for i in range(50):
            at = rng.choice(N.SYMBOLS, distance, replace=False)
            b[i, at] ^= rng.integers(1, 1 << 16, distance).astype(np.uint16)
        shared = [bool(set(x) & set(y)) for x, y in zip(N.keys(a).tolist(), N.keys(b).tolist(), strict=True)]
        assert all(shared)


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    a, b = N.shingles(" ".join(words)), N.shingles(" ".join(words[60:] + [f"z{i}" for i in range(60)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = np.mean(N.signature(a) == N.signature(b))
    assert abs(j - equal) < 0.15 and N.similar(a, a) and not N.similar(a, b)


def test_sets_equal_words():
    for text in ("", " \t", "a", "a b c d e", "a b c d e f", "A\x0bB\x0cc", "ä Ä", "a b c d e f g", "x " * 50):
        assert len(N.shingles(text)) == len(shingle_set(text))


def test_runs_name_the_smallest_document_of_each_key(spark):
    rows = [(k, r) for k, reps in {1: [5], 2: [7, 3, 9], 3: [4, 4], 4: list(range(50, 0, -1)), -5: [8]}.items() for r in reps]
    got = sorted(tuple(r) for r in N._runs(spark.createDataFrame(rows, "key long, rep long").repartition(3)).collect())
    assert got == sorted((k, r, {2: 3, 3: 4, 4: 1}[k]) for k, r in rows if k in (2, 3, 4))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (205, 200), (7, 7)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and got[205] == 200 and all(got[300 + k] == 300 for k in range(1, 30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert result(queries.QUERIES["op2_near_dedup"](spark, tiny)) == brute(rows)


def brute_at(rows, percent):
    """The smallest id of each row's component, by full comparison of all pairs."""
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    low = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while True:
        new = dict(low)
        for i, j in linked:
            new[i] = new[j] = min(new[i], new[j])
        if new == low:
            return low
        low = new


def test_stage_links_from_eighty_percent(spark):
    rows = corpus()
    at_80, at_85 = brute_at(rows, 80), brute_at(rows, 85)
    assert len(set(at_80.values())) < len(set(at_85.values()))
    kept = {r["doc_id"] for r in N.drop_near_copies(frame(spark, rows)).collect()}
    assert kept == set(at_80.values())


def test_wide_layout_is_as_safe():
    from math import comb

    def missed(layout):
        p = (100 - layout.percent) / 100
        return sum(comb(layout.symbols, k) * p**k * (1 - p) ** (layout.symbols - k) for k in range(layout.radius + 1, layout.symbols + 1))

    assert missed(N.LAYOUTS[80]) <= missed(N.LAYOUTS[85])
    rng, layout = np.random.default_rng(3), N.LAYOUTS[80]
    a = rng.integers(0, 1 << 16, (50, layout.symbols)).astype(np.uint16)
    b = a.copy()
    for i in range(50):
        b[i, rng.choice(layout.symbols, layout.radius, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(N.keys(a, layout).tolist(), N.keys(b, layout).tolist(), strict=True))


def test_components_split_a_node_of_very_many_links(spark):
    """A star of 30 000 links and a few chains: right components, and the star's joins are marked as skewed."""
    from larder.llm import components as C
    from larder.llm.common import stored

    star = spark.range(1, 30_001).selectExpr("0L AS a", "id AS b")
    chains = spark.range(3000).selectExpr("100000 + id * 2 AS a", "100001 + id * 2 AS b")
    links = stored(star.union(chains).repartition(16), "links")
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        moved, _ = C._large(links)
        moved.collect()
        assert "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = C.components(links)
    assert got.filter("node <= 30000").select("component").distinct().collect() == [(0,)]
    assert got.filter("node > 30000 AND component = node - node % 2").count() == 3000
