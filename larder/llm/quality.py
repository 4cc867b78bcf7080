"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers each vote good, bad or nothing on a document. Only the table of vote
patterns is aggregated (at most 3 to the power of the number of labellers rows); on it,
expectation-maximisation estimates every labeller's accuracy and the share of good documents,
without any given label. The posterior labels of a bounded, hash-chosen sample (TRAIN_ROWS) then
train a logistic scorer on hashed features of the text, and the scorer rates every document.

Reading a text is one pass over its distinct words; their shapes are kept in a bounded cache. Votes
and features are stored once (a few numbers a document), so the model is fitted and documents are
rated without a second reading; only `scored`, which hands on whole rows, reads texts again.

Defined cases: null, empty and blank texts score 0 and are rejected; texts too short for a
labeller get no vote from it, so a short clean text stays; very long texts are read whole; equal
rows score alike; extra columns ride along, columns with the result's names are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import OWN, appended, dropped, in_sample, small_batches, stored, texts_of, with_fields

#: Size of the hashed feature space, rows of the training sample, score from which a document is kept.
DIMENSIONS, TRAIN_ROWS, KEEP = 1 << 14, 10_000, 0.5
CACHE = 60_000
#: A labeller's limits are set so that it objects to about this share of good documents. EM takes that as its
#: prior, worth BELIEF votes of each labeller for each document of the corpus, so it weighs alike at every size: without one, a fault
#: that only few labellers see would be taken for a habit of good texts.
FALSE_ALARMS, BELIEF = 0.001, 0.2
GOOD, BAD, NONE = 1, 2, 0

SENTENCE = re.compile(r"[.!?\n]+\s*")
USUAL = ".,;:!?"
#: Signs of a shape that prose has singly: anything else, or a double one, is unusual.
UNUSUAL = re.compile(r"[^Xx9.,;:!?'\"()\-]|([.,;:!?'\"()\-])\1")


def shape(word: str) -> str:
    """A word's capitals (XX if several), small letters (x), digits (9) and signs, runs cut short."""
    core, end = (word[:-1], word[-1]) if word[-1] in USUAL else (word, "")
    if core.isalpha():
        if core.islower():
            return "x" + end
        if core.isupper():
            return ("XX" if len(core) > 1 else "X") + end
        if core.istitle():
            return "Xx" + end
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1{2,}", r"\1\1", kinds).replace("xx", "x").replace("99", "9")


class _Shapes(dict):
    """word -> its shape, for the words met first."""

    def __missing__(self, word: str) -> str:
        out = shape(word)
        if len(self) < CACHE and len(word) <= 40:
            self[word] = out
        return out


class _Traits(dict):
    """shape -> its feature, whether it has letters or digits, is all capitals, has unusual signs, shouts."""

    def __missing__(self, shape: str) -> tuple[int, bool, bool, bool, bool]:
        known = any(c in "Xx9" for c in shape)
        out = xxhash.xxh32_intdigest(shape) % DIMENSIONS, known, "XX" in shape and "x" not in shape, bool(UNUSUAL.search(shape)), shape.endswith("!!")
        if len(self) < CACHE and len(shape) <= 40:
            self[shape] = out
        return out


_SHAPES, _TRAITS = _Shapes(), _Traits()
LABELLERS = ("signs", "separators", "capitals", "stammer", "bigrams", "sentences", "shouting", "redundancy", "prose", "commonest")


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to one limit, bad from the other on."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def read(text: str) -> tuple[tuple[int, ...], dict[int, float]]:
    """Votes and hashed features of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return (NONE,) * len(LABELLERS), {}
    counts, tally = Counter(words), {}
    for w, c in counts.items():
        s = _SHAPES[w]
        tally[s] = tally.get(s, 0) + c
    features: dict[int, float] = {}
    lone = capitals = signed = shouts = plain = 0
    for s, c in tally.items():
        feature, known, upper, signs, shout = _TRAITS[s]
        features[feature] = features.get(feature, 0) + c
        lone += c * (not known)
        capitals += c * upper
        signed += c * signs
        shouts += c * shout
        plain += c * (known and not signs)
    stammer = sum(map(operator.eq, words, words[1:]))
    bigrams = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    parts = [p for p in SENTENCE.split(text) if len(p) > 20]
    repeated = 1 - len(set(parts)) / len(parts) if parts else 0.0
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    votes = (
        _vote(signed / n, 0.1, 0.3) if n >= 5 else NONE,
        _vote(lone / n, 0.02, 0.15) if n >= 5 else NONE,
        _vote(capitals / n, 0.15, 0.5) if n >= 10 else NONE,
        _vote(stammer / n, 0.02, 0.15) if n >= 10 else NONE,
        _vote(1 - bigrams, 0.1, 0.5) if n >= 20 else NONE,
        _vote(repeated, 0.05, 0.5) if len(parts) >= 4 else NONE,
        _vote(shouts / n, 0.01, 0.15) if n >= 5 else NONE,
        _vote(1 - packed, 0.72, 0.85) if len(raw) >= 300 else NONE,
        _vote(1 - plain / n, 0.1, 0.35) if n >= 10 else NONE,
        _vote(max(counts.values()) / n, 0.12, 0.3) if n >= 20 else NONE,
    )
    # Marks of repetition as further features; each feature is the share of words, on a root scale.
    for name, value in (("stammer", stammer), ("bigrams", (1 - bigrams) * n), ("repeated", repeated * n), ("packed", max(0.0, 0.8 - packed) * n if len(raw) >= 300 else 0)):
        features[xxhash.xxh32_intdigest(name, 1) % DIMENSIONS] = value
    return votes, {k: math.sqrt(v / n) for k, v in features.items() if v > 0}


def _pattern(votes: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


FEATURES = "doc_id long, text_hash long, pattern int, keys array<int>, shares array<float>"


def features_of(docs: DataFrame) -> DataFrame:
    """Of each document: a hash of its text, its vote pattern as one number, and its features."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = [read(t) for t in texts_of(b)]
            columns = [
                b.column(b.schema.get_field_index("doc_id")),
                b.column(b.schema.get_field_index("text_hash")),
                pa.array([_pattern(v) for v, _ in got], pa.int32()),
                pa.array([list(f) for _, f in got], pa.list_(pa.int32())),
                pa.array([list(f.values()) for _, f in got], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "pattern", "keys", "shares"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(take, FEATURES)


class LabelModel:
    """What EM knows of the labellers: share of good documents, and chances[class, labeller, vote]."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarms: float | None = FALSE_ALARMS, belief: float = BELIEF):
        k = len(LABELLERS)
        votes = np.stack([patterns // 3**i % 3 for i in range(k)], 1)
        # Start: each labeller looks for a fault of its own, so one objection makes a document suspect.
        p = np.where((votes == BAD).any(1), 0.1, 0.9)
        hot = np.stack([votes == v for v in range(3)], 2).astype(float)
        faith = np.zeros(3) if false_alarms is None else belief * float(counts.sum()) * np.array([0, 1 - false_alarms, false_alarms])
        for _ in range(rounds):
            self.prior = (float((p * counts).sum()) + 1) / (float(counts.sum()) + 2)
            self.chances = np.empty((2, k, 3))
            for c, q in ((0, p), (1, 1 - p)):
                # Only votes cast count: that a labeller is silent says nothing but that a text is short.
                cast = np.einsum("r,rkv->kv", q * counts, hot) + np.array([0, 1.0 + (c == 0), 1.0 + (c == 1)]) + (c == 0) * faith
                cast[:, NONE] = 0
                self.chances[c] = cast / cast.sum(1, keepdims=True)
                self.chances[c][:, NONE] = 1
            new = self.posterior(patterns)
            if np.abs(new - p).max(initial=0) < 1e-9:
                break
            p = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a document with these votes is good."""
        logs = [np.log(self.prior), np.log(1 - self.prior)]
        for i in range(len(LABELLERS)):
            v = patterns // 3**i % 3
            for c in (0, 1):
                logs[c] = logs[c] + np.log(self.chances[c, i, v])
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """The estimated chance that a vote cast by a labeller is right."""
        right = self.prior * self.chances[0, :, GOOD] + (1 - self.prior) * self.chances[1, :, BAD]
        return dict(zip(LABELLERS, right.tolist(), strict=True))


def _trained(rows: list, labels: np.ndarray, rounds: int = 600, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic function, by gradient steps with momentum on the whole sample."""
    size = np.array([len(r["keys"]) for r in rows])
    keys = np.concatenate([np.asarray(r["keys"], np.int64) for r in rows])
    values = np.concatenate([np.asarray(r["shares"]) for r in rows])
    at = np.repeat(np.arange(len(rows)), size)
    w, speed, b, b_speed = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    # Every row weighs the same, so where features say little the score is the share of good documents.
    weight = 1 / len(rows)
    for _ in range(rounds):
        z = np.bincount(at, values * w[keys], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        gradient = np.bincount(keys, values * error[at], DIMENSIONS) + ridge * w
        speed = 0.9 * speed - 2.0 * gradient
        b_speed = 0.9 * b_speed - 2.0 * error.sum()
        w, b = w + speed, b + b_speed
    return w, b


def fitted(features: DataFrame) -> tuple[LabelModel, np.ndarray, float]:
    """The label model and the scorer's weights and intercept, from stored features."""
    patterns = features.groupBy("pattern").count().toPandas()
    seen, counts = patterns["pattern"].to_numpy(np.int64), patterns["count"].to_numpy(float)
    model = LabelModel(seen, counts)
    share = min(1.0, TRAIN_ROWS / max(1.0, counts.sum()))
    while True:
        # Equal texts have one hash: the sample takes each once, so its size doesn't hang on copies.
        chosen = features.filter(in_sample(F.col("text_hash"), share) & (F.size("keys") > 0))
        rows = chosen.select("text_hash", "pattern", "keys", "shares").dropDuplicates(["text_hash"]).collect()
        if rows or share >= 1:
            break
        # Where nearly all rows are copies of a few texts the share may hold none: a larger one then.
        share = min(1.0, 16 * share)
    if not rows:
        # Nowhere a word: such documents score 0 whatever the weights.
        return model, np.zeros(DIMENSIONS), 0.0
    w, b = _trained(rows, model.posterior(np.array([r["pattern"] for r in rows], np.int64)))
    return model, w, b


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, quality_score and accepted of every document; texts are read once."""
    features = stored(features_of(docs), "features")
    _, w, intercept = fitted(features)
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            keys, shares = b.column(b.schema.get_field_index("keys")), b.column(b.schema.get_field_index("shares"))
            size = np.diff(keys.offsets.to_numpy())
            terms = w[keys.flatten().to_numpy()] * shares.flatten().to_numpy()
            z = np.bincount(np.repeat(np.arange(len(size)), size), terms, len(size)) + intercept
            out = np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(out, pa.float64())], ["doc_id", "quality_score"])

    return features.select("doc_id", "keys", "shares").mapInArrow(score, "doc_id long, quality_score double").withColumn("accepted", F.col("quality_score") >= KEEP)


def scored(docs: DataFrame, weights: np.ndarray, intercept: float, name: str = "quality_score") -> DataFrame:
    """docs and quality_score, the chance that a document is good."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in small_batches(batches):
            features = [read(t)[1] for t in texts_of(b)]
            out = [_chance(intercept + sum(float(w[k]) * v for k, v in f.items())) if f else 0.0 for f in features]
            yield appended(b, [name], [pa.array(out, pa.float64())])

    return docs.mapInArrow(score, with_fields(docs.schema, T.StructField(name, T.DoubleType())))


def quality(docs: DataFrame) -> DataFrame:
    """docs with quality_score and accepted."""
    _, w, b = fitted(stored(features_of(docs), "features"))
    return scored(docs, w, b).withColumn("accepted", F.col("quality_score") >= KEEP)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    features = stored(features_of(docs), "features")
    _, w, b = fitted(features)
    dropped(features)
    score = f"{OWN}score"
    return scored(docs, w, b, score).filter(F.col(score) >= KEEP).drop(score)
