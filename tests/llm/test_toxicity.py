import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from larder.llm import queries
from larder.llm import toxicity as X
from tests.llm.conftest import ROWS, frame


@pytest.mark.parametrize("text", ["IDIOT", "1d10t", "іdіоt", "ídïôt", "id​iot", "idiooooot", "@idiot", "i$tupid stup!d idi0t"])
def test_folding_undoes_disguises(text):
    words = X.folded_words(text)
    assert any(w.replace("oo", "o") == "idiot" or w == "stupid" for w in words), words


def test_disguises_are_found_wherever_they_stand():
    plain = re.compile(r"[^\W\d_][@$!|*]+[^\W\d_]|[@$][^\W\d_]|[^\W\d_][013457]|[013457][^\W\d_]")
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@$!|* 01923_é") for _ in range(rng.randrange(8)))
        assert bool(X.DISGUISED.search(text)) == bool(plain.search(text)), text


def test_folding_leaves_plain_words():
    assert X.folded_words("Hello, good books! 2024 it's") == ["hello", "good", "books", "2024", "it", "s"]
    assert X.folded_words("") == []


def test_whole_words_stems_and_exceptions():
    x = X.Lexicon({"trash": 3.0, "vequ~": 2.0, "vequx": 4.0}, ["trash can"])
    assert x.matches("a trash b".split()) == {1: 3.0} or list(x.matches("a trash b".split()).values()) == [3.0]
    assert not x.matches("trashy".split()) and list(x.matches("vequta".split()).values()) == [2.0]
    assert list(x.matches(["vequx"]).values()) == [4.0]
    assert not x.matches("the trash can".split()) and len(x.matches("trash trash can trash".split())) == 2


def test_matches_against_brute_force():
    import random

    rng, terms = random.Random(2), {"ab": 1.0, "abc": 2.0, "b": 4.0, "ca~": 8.0}
    x = X.Lexicon(terms)
    for _ in range(500):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))]
        want = sum(max([terms.get(w, 0.0)] + [8.0] * w.startswith("ca")) for w in words)
        assert sum(x.matches(words).values()) == want


def labelled_corpus(n=800):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{(i * 31 + k * 17) % 97}" for k in range(30 + i % 50)]
        if toxic:
            words[7] = ("grumblo", "snarkel")[i % 8 // 4]
        elif i % 4 == 1:
            words[7:9] = ["grumblo", "fish"]
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_terms_and_exceptions(spark):
    docs, labels = labelled_corpus()
    # Clean uses of a term outweigh it as a word; as a phrase they are an exception of the base list.
    base = {"grumblo": 3.0}
    train = X.labelled(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    x = X.learned(train, base)
    assert "snarkel" in x.terms and "grumblo fish" in x.exceptions
    assert x.score("a snarkel here") > 0.5 > x.score("a grumblo fish here") and x.score("") < 0.3


def test_held_out_rows_teach_nothing(spark):
    docs, labels = labelled_corpus(400)
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(tuple(r) for r in X.toxic_documents(frame(spark, docs), spark.createDataFrame(x, schema)).collect()) for x in (labels, turned))
    assert a == b and {r[0] for r in a if r[1]} == held


def test_odd_rows(spark, odd, empty, no_id):
    labels = spark.createDataFrame([(1, 1, 0), (8, None, 1), (None, 1, 1), (8, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    out = X.toxic_documents(odd, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.collect())
    none = labels.limit(0)
    assert X.toxic_documents(empty, labels).count() == 0 and X.toxic_documents(odd, none).count() == len(ROWS)
    assert X.toxic_documents(no_id, none).filter("doc_id IS NULL AND NOT held_out").count() == 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op8_toxicity"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    found = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert found >= 0.85 and wrong <= 0.01


def brute_lexicon(rows, base):
    """Terms with weights and exception phrases, counted document by document."""
    toxic, clean, n = defaultdict(set), Counter(), Counter(t for _, t in rows)
    for text, label in rows:
        words = X.folded_words(text)
        terms = {w for w in words if len(w) > 2}
        terms |= {w[:k] + "~" for w in terms for k in (4, 5) if len(w) > k}
        origin = min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 2])) for i in range(len(words) - 1)), default=0) // 2
        for t in terms:
            if label:
                toxic[t].add(origin)
            else:
                clean[t] += 1
    out = dict(base)
    for t, origins in toxic.items():
        k, c = len(origins), clean[t]
        odds = math.log((k + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if k >= max(5, n[1] / 2000) and odds >= math.log(12) and odds >= 3 * math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5)):
            out[t] = odds
    uses, with_term = defaultdict(Counter), Counter()
    for text, label in rows:
        words = X.folded_words(text)
        hit = [w in out or w[:4] + "~" in out or w[:5] + "~" in out for w in words]
        with_term[label] += any(hit)
        for p in {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}:
            uses[p][label] += 1
    spared = {p for p, c in uses.items() if c[0] >= max(5, with_term[0] / 2000) and c[0] >= 4 * c[1]}
    return out, spared


@pytest.mark.parametrize("base", [{}, {"grumblo": 3.0}])
def test_learning_against_brute_force(spark, base):
    docs, labels = labelled_corpus()
    folder = "/root/testdata/sf0.01"
    known = {r["doc_id"]: int(r["toxic"] > 0) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(d[1], int(t)) for d, (_, _, t) in zip(docs, labels, strict=True)]
    rows += [(r["text"], known[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] in known]
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int").repartition(5)
    got = X.learned(train, base)
    terms, spared = brute_lexicon(rows, base)
    assert set(got.terms) == set(terms) and got.terms == pytest.approx(terms) and set(got.exceptions) == spared
    # Slope and intercept: no direction improves the likelihood of the different texts (ridge included).
    x, y = np.array([(got.measure(t), label) for t, label in set(rows)]).T
    p = 1 / (1 + np.exp(-(got.slope * x + got.intercept)))
    assert abs(((p - y) * x).sum() + 0.01 * got.slope) < 1e-3 and abs((p - y).sum() + 0.01 * got.intercept) < 1e-3


def test_fit_of_odd_samples(spark, monkeypatch):
    """A sample that is empty at first grows; with one kind of label the preset slope stays and the empty text is clean."""
    kind = "doc_id long, text string, toxic int"
    x = X.Lexicon({"grumblo": 4.0})
    one = spark.createDataFrame([(i, f"w{i}", 0) for i in range(30)], kind)
    assert X._fit(one, x, 10**12) == (1.0, -4.0) and X._fit(one.limit(0), x, 10**12) == (1.0, -4.0)
    both = spark.createDataFrame([(i, f"grumblo w{i % 3}" if i % 2 else f"w{i % 3}", i % 2) for i in range(300)], kind)
    slope, intercept = X._fit(both, x, 10**12)
    assert slope > 0 > intercept


def test_every_significant_term_is_kept(spark):
    """Far more terms than a fixed number of rows would hold, frequent ones with moderate odds among them."""
    rare = lambda i: " ".join(random.Random(i).sample([f"q{i % 8}z{j}" for j in range(3500)], 3500))
    docs = [(i, f"{rare(i)} grumblo n{i} m{i}", "en", "s") for i in range(40)]
    docs += [(1000 + i, f"plain words {'grumblo' if i < 20 else 'here'} c{i} d{i}", "en", "s") for i in range(400)]
    labels = [(i, 1, int(i < 1000)) for i, *_ in docs]
    train = X.labelled(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    x = X.learned(train, {})
    assert "grumblo" in x.terms and sum(t[0] == "q" and not t.endswith(X.STEM) for t in x.terms) == 28_000
    # A term too rare among many toxic documents is no term.
    few = [(i, f"rarum r{i} s{i}" if i < 5 else f"t{i} u{i} vexo", "en", "s") for i in range(11_000)] + [(20_000 + i, f"c{i} d{i}", "en", "s") for i in range(400)]
    labels = [(i, 1, int(i < 20_000)) for i, *_ in few]
    x = X.learned(X.labelled(frame(spark, few), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), {})
    assert "vexo" in x.terms and "rarum" not in x.terms
