import math
import random

import numpy as np
from pyspark.sql import functions as F

from larder.llm import quality as Q
from larder.llm import queries
from larder.llm.common import in_sample, sample_bound, stored
from tests.llm.conftest import CLASHING, ROWS, frame

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS) for _ in range(rng.randrange(5, 14))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return out


def corpus(n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = prose(rng, rng.randrange(40, 200))
        kind = i % 10
        if kind == 0:
            w = [x + rng.choice(("%%%", "###", "&&&")) for x in w]
        elif kind == 1:
            w = " | ".join(w).split(" ")
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        elif kind == 3:
            w = [x for x in w[:5] for _ in range(20)]
        rows.append((i, " ".join(w), "en", "s"))
    return rows


def test_tells_faulty_texts(spark):
    rows = corpus()
    got = {r["doc_id"]: r["accepted"] for r in Q.quality(frame(spark, rows)).collect()}
    assert got == {r[0]: r[0] % 10 > 3 for r in rows}


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    k, n = len(Q.LABELLERS), 20_000
    good = rng.random(n) < 0.7
    right = np.linspace(0.95, 0.75, k)
    votes = np.where(rng.random((n, k)) < right, np.where(good, Q.GOOD, Q.BAD)[:, None], np.where(good, Q.BAD, Q.GOOD)[:, None])
    votes[rng.random((n, k)) < 0.2] = Q.NONE
    patterns, counts = np.unique((votes * 3 ** np.arange(k)).sum(1), return_counts=True)
    model = Q.LabelModel(patterns, counts.astype(float), 300, false_alarms=None)
    assert abs(model.prior - 0.7) < 0.03
    assert max(abs(a - b) for a, b in zip(model.accuracies().values(), right, strict=True)) < 0.03
    p = model.posterior((votes * 3 ** np.arange(k)).sum(1))
    assert ((p > 0.5) == good).mean() > 0.97


def test_odd_rows(spark, odd, empty):
    rows = corpus(200) + [(1000 + i, *r[1:]) for i, r in enumerate(ROWS)]
    docs = frame(spark, rows, clash=True)
    out = Q.quality(docs)
    got = {r["doc_id"]: (r["quality_score"], r["accepted"]) for r in out.collect()}
    assert got[1002] == got[1003] == got[1004] == (0.0, False)
    assert got[1000][1] and got[1007][1] and got[1007] == got[1009] == got[1014]
    stage = Q.accepted(docs)
    assert stage.columns == docs.columns and all(r[c] == f"{c}!" for r in stage.collect() for c in CLASHING)
    assert Q.quality(empty).count() == 0 and Q.quality(odd).count() == len(ROWS)


def test_em_prior_weighs_alike_at_every_size():
    """The same patterns, a million times as often: the same model, and false alarms are estimated, not set."""
    rng = np.random.default_rng(2)
    k, n = len(Q.LABELLERS), 5000
    good = rng.random(n) < 0.8
    alarm = np.where(np.arange(k) == 2, 0.02, 0.0005)
    votes = np.where(rng.random((n, k)) < np.where(good[:, None], alarm, 0.6), Q.BAD, Q.GOOD)
    patterns, counts = np.unique((votes * 3 ** np.arange(k)).sum(1), return_counts=True)
    small, large = Q.LabelModel(patterns, counts.astype(float)), Q.LabelModel(patterns, counts * 1e6)
    assert np.allclose(small.chances, large.chances, atol=2e-3) and abs(small.prior - 0.8) < 0.02
    seen = np.array([(votes[good][:, i] == Q.BAD).mean() for i in range(k)])
    want = (seen * 0.8 + Q.BELIEF * Q.FALSE_ALARMS) / (0.8 + Q.BELIEF)
    assert np.allclose(large.chances[0, :, Q.BAD], want, atol=2e-3) and large.chances[0, 2, Q.BAD] > 5 * large.chances[0, 0, Q.BAD]


def test_sample_of_a_huge_corpus_is_not_empty(spark, monkeypatch):
    for total in (10**4, 10**7, 10**11, 10**14):
        assert abs(sample_bound(Q.TRAIN_ROWS / total) / 2**63 * total / Q.TRAIN_ROWS - 1) < 1e-6
    assert sample_bound(1.0) == 2**63 - 1 and sample_bound(0.0) == 0
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert 150 < hashes.filter(in_sample(F.col("h"), 0.01)).count() < 250
    # Few texts, each very often: the first share holds none of them.
    rows = corpus(20) * 40
    monkeypatch.setattr(Q, "TRAIN_ROWS", 1)
    got = {r["doc_id"]: r["accepted"] for r in Q.rated(frame(spark, rows)).collect()}
    assert len(got) == 20 and any(got.values())


def test_scores_equal_a_plain_version(spark):
    """Votes, model and weighted sums once more, document by document."""
    rows = corpus(120, 3)
    docs = frame(spark, rows)
    model, w, b = Q.fitted(stored(Q.features_of(docs), "features"))
    got = {r["doc_id"]: r["quality_score"] for r in Q.rated(docs).collect()}
    for doc_id, text, *_ in rows:
        z = b + sum(w[k] * v for k, v in Q.read(text)[1].items())
        assert abs(got[doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4
    # The posterior by Bayes' rule, vote by vote.
    for _, text, *_ in rows[:30]:
        votes = Q.read(text)[0]
        chance = [model.prior, 1 - model.prior]
        for i, v in enumerate(votes):
            for c in (0, 1):
                chance[c] *= model.chances[c, i, v] if v != Q.NONE else 1
        p = model.posterior(np.array([Q._pattern(votes)]))[0]
        assert abs(p - chance[0] / sum(chance)) < 1e-9


def test_rated_odd_rows(spark, odd, empty, no_id):
    """The function behind op7_quality on nulls, empties, very long texts, repeats and clashing names."""
    rows = corpus(200) + [(1000 + i, *r[1:]) for i, r in enumerate(ROWS)]
    out = Q.rated(frame(spark, rows, clash=True))
    assert out.columns == ["doc_id", "quality_score", "accepted"]
    got = {r["doc_id"]: (r["quality_score"], r["accepted"]) for r in out.collect()}
    assert len(got) == len(rows) and got[1002] == got[1003] == got[1004] == (0.0, False)
    assert got[1005][1] and got[1006][1] and got[1007] == got[1009] == got[1014]
    assert Q.rated(odd).count() == len(ROWS) and Q.rated(no_id).count() == 3
    assert Q.rated(empty).count() == 0 and Q.accepted(empty).count() == 0 and Q.accepted(empty).columns == empty.columns


def test_long_words_are_read_to_their_end():
    assert Q.shape("a" * 48 + "%#" * 500) != Q.shape("a" * 600) and "%" in Q.shape("a" * 60 + "%")


def test_held_out_labels(spark):
    """Scores fitted without any label, held against the labels."""
    folder = "/root/testdata/sf0.01"
    scores = queries.QUERIES["op7_quality"](spark, folder)
    assert scores.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r["accepted"] for r in rows if r["quality"] == 1]
    bad = [r["accepted"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1


# A plain version of everything: words one by one, EM over documents, training by loops.


def plain_shape(word):
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    out = []
    for k in kinds:
        if not (len(out) > 1 and out[-1] == out[-2] == k):
            out.append(k)
    return "".join(out).replace("xx", "x").replace("99", "9")


def plain_read(text):
    import zlib

    import xxhash

    words = text.split()
    n = len(words)
    if not n:
        return [0] * 10, {}
    shapes = [plain_shape(w) for w in words]
    known = [any(c in "Xx9" for c in s) for s in shapes]
    prose = ".,;:!?'\"()-"
    odd = [any(c not in "Xx9" + prose for c in s) or any(a == b and a in prose for a, b in zip(s, s[1:], strict=False)) for s in shapes]
    share = lambda flags: sum(flags) / n
    pairs = list(zip(words, words[1:], strict=False))
    stammer = sum(a == b for a, b in pairs)
    repeats = 1 - len(set(pairs)) / len(pairs) if pairs else 0.0
    parts, part = [], ""
    for c in text:
        part = part + c if c not in ".!?\n" else (parts.append(part) or "")
    parts = [p for p in (x.lstrip() for x in [*parts, part]) if len(p) > 20]
    again = 1 - len(set(parts)) / len(parts) if parts else 0.0
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    most = max(words.count(w) for w in set(words))
    measured = [
        (share(odd), 0.1, 0.3, n >= 5), (1 - share(known), 0.02, 0.15, n >= 5), (share(["XX" in s and "x" not in s for s in shapes]), 0.15, 0.5, n >= 10), (stammer / n, 0.02, 0.15, n >= 10), (repeats, 0.1, 0.5, n >= 20),
        (again, 0.05, 0.5, len(parts) >= 4), (share([s.endswith("!!") for s in shapes]), 0.01, 0.15, n >= 5), (1 - packed, 0.72, 0.85, len(raw) >= 300), (1 - share([k and not o for k, o in zip(known, odd, strict=True)]), 0.1, 0.35, n >= 10), (most / n, 0.12, 0.3, n >= 20),
    ]
    votes = [0 if not long else 1 if v <= good else 2 if v >= bad else 0 for v, good, bad, long in measured]
    features = {}
    for s in shapes:
        key = xxhash.xxh32_intdigest(s) % 16384
        features[key] = features.get(key, 0) + 1
    for name, value in (("stammer", stammer), ("bigrams", repeats * n), ("repeated", again * n), ("packed", max(0.0, 0.8 - packed) * n if len(raw) >= 300 else 0)):
        features[xxhash.xxh32_intdigest(name, 1) % 16384] = value
    return votes, {k: math.sqrt(v / n) for k, v in features.items() if v > 0}


def plain_em(all_votes):
    p = [0.1 if 2 in v else 0.9 for v in all_votes]
    n = len(all_votes)
    for _ in range(100):
        prior = (sum(p) + 1) / (n + 2)
        chance = {}
        for good in (True, False):
            for k in range(10):
                cast = {v: sum((q if good else 1 - q) for q, votes in zip(p, all_votes, strict=True) if votes[k] == v) + (2.0 if (v == 1) == good else 1.0) for v in (1, 2)}
                if good:
                    cast[1] += 0.2 * n * 0.999
                    cast[2] += 0.2 * n * 0.001
                chance |= {(good, k, v): cast[v] / (cast[1] + cast[2]) for v in (1, 2)} | {(good, k, 0): 1.0}
        new = []
        for votes in all_votes:
            a, b = prior, 1 - prior
            for k, v in enumerate(votes):
                a, b = a * chance[True, k, v], b * chance[False, k, v]
            new.append(a / (a + b))
        done = max(abs(x - y) for x, y in zip(p, new, strict=True)) < 1e-9
        p = new
        if done:
            break
    return p


def plain_train(rows, labels):
    w, speed, b, b_speed = {}, {}, 0.0, 0.0
    keys = {k for r in rows for k in r}
    w, speed = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    for _ in range(600):
        gradient, errors = {k: 3e-5 * w[k] for k in keys}, 0.0
        for r, y in zip(rows, labels, strict=True):
            z = b + sum(w[k] * v for k, v in r.items())
            e = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) / len(rows)
            errors += e
            for k, v in r.items():
                gradient[k] += e * v
        for k in keys:
            speed[k] = 0.9 * speed[k] - 2.0 * gradient[k]
            w[k] += speed[k]
        b_speed = 0.9 * b_speed - 2.0 * errors
        b += b_speed
    return w, b


def test_query_equals_a_plain_version(spark, tiny):
    """Votes, accuracies, training and scores of the registered query, all computed anew without the library."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    read = {i: plain_read(t) for i, t in docs.items()}
    label = dict(zip(docs, plain_em([read[i][0] for i in docs]), strict=True))
    first = {t: i for i, t in reversed(docs.items())}
    sample = [i for i in first.values() if read[i][1]]
    w, b = plain_train([read[i][1] for i in sample], [label[i] for i in sample])
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality"](spark, tiny).collect()}
    assert set(got) == set(docs)
    for i in docs:
        f = read[i][1]
        z = b + sum(w[k] * v for k, v in f.items())
        score = 1 / (1 + math.exp(-z)) if f else 0.0
        assert abs(got[i]["quality_score"] - score) < 1e-3, i
        assert got[i]["accepted"] == (score >= 0.5) or abs(score - 0.5) < 1e-3
