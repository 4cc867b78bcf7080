"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding undoes the usual disguises: compatibility forms and accents are decomposed, Cyrillic and
Greek look-alikes become Latin letters, digits and signs inside a word become the letters they
stand for, invisible characters go, repeated letters shrink. The lexicon holds a base list and
terms learned from labelled training documents: a folded word, or the first four or five letters of
words (a stem), that stands in several independent toxic documents (SUPPORT, and MIN_SHARE of all) and
significantly less in others. Near
copies of one document count as one: documents whose smallest word-pair hash is the same. A term's
weight is its smoothed log odds. Exception phrases, two-word phrases around a term that are common
in documents labelled clean, take their match back.

A document's score is the logistic function of its summed weights, normalised by the logarithm of
its length in words; slope and intercept are fitted on the training labels of a bounded sample of texts. The text is read as a
stream of folded words, so a term counts as a whole word, and a stem at the start of a word only.

Labels, language, source and doc_id are no inputs of a score. Counting
aggregates over all training documents, clean ones map-side combined; to the driver come only terms that pass the support and
odds limits, every one of them, and the score sums of a bounded sample for the fit (about FIT_ROWS different
texts, chosen by a hash of the text). What bounds the lexicon is the share of documents: with D terms in a toxic document on the average, at most
D / MIN_SHARE terms reach MIN_SHARE of them, and likewise for phrases in clean documents with a term, however large the
corpus.

Defined cases: null and empty texts score the intercept alone; very long texts are read whole;
equal rows score alike; without any label the base list with its preset weights and slope is used, without
both kinds of label in the sample the preset slope;
an empty table gives an empty result; extra columns ride along, columns with the result's names are
replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import OWN, appended, dropped, in_sample, small_batches, stored, texts_of, with_fields

# Insults in four languages with preset weights, all in folded form.
BASE = {
    "idiot": 4.0, "moron": 4.0, "scum": 4.0, "loser": 3.5, "stupid": 3.5, "worthless": 3.5, "pathetic": 3.5, "disgusting": 3.5, "trash": 3.0, "clown": 3.0,
    "imbecil": 4.0, "estupido": 4.0, "basura": 3.0, "connard": 4.0, "imbecile": 4.0, "debile": 3.5, "arschloch": 4.0, "dummkopf": 3.5, "abschaum": 4.0, "trottel": 3.5,
}

# Look-alikes of Latin letters (Cyrillic, then Greek, then others), and digits and signs that stand for letters inside words.
LOOKS = str.maketrans(
    {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "г": "r"}
    | {"α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
    | {"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ℓ": "l", "ł": "l", "ø": "o", "đ": "d"}
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None})
PLAIN = re.compile(r"[^\W_]+")
#: Words with signs inside; and whether there are any, or any digits next to letters.
SIGNED = re.compile(r"[@$]?[^\W_]+(?:[@$!|*]+[^\W_]+)*")
#: They begin with a sign, so that a search skips from sign to sign.
DISGUISED = re.compile(r"[@$!|*013457](?:(?<=[@$013457])(?=[^\W\d_])|(?<=[^\W\d_][013457])|(?<=[^\W\d_][@$!|*])[@$!|*]*[^\W\d_])")
MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")
FOREIGN = re.compile("[\u0131\u0142\u00f8\u0111\u0251\u0261\u0269\u2113\u0370-\u052f]")
TRIPLE = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
SHRINK = re.compile(r"([a-z])\1{2,}")

#: A learned term stands in at least this many independent toxic training documents, with at least these odds against clean ones.
SUPPORT, ODDS = 5, 12.0
#: Support as a share of the toxic documents, or for exceptions of the clean documents with a term; standard errors by which the log odds exceed 0.
MIN_SHARE, ERRORS = 1 / 2000, 3.0
#: Lengths of stems; the mark of a stem in a lexicon.
STEMS, STEM = (4, 5), "~"
FIT_ROWS = 20_000
THRESHOLD = 0.3


def folded_words(text: str) -> list[str]:
    """The text's words without disguises."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(LOOKS)
    if any(t in text for t in TRIPLE):
        text = SHRINK.sub(r"\1\1", text)
    if not DISGUISED.search(text):
        return PLAIN.findall(text)
    return [w if w.isalpha() or w.isdigit() else w.lstrip("@").translate(SIGNS) for w in SIGNED.findall(text)]


class Lexicon:
    """Weighted terms and exception phrases in one automaton over ' word word ... '."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = (), slope: float = 1.0, intercept: float = -4.0):
        self.terms, self.exceptions, self.slope, self.intercept = dict(terms), list(exceptions), slope, intercept
        self.automaton = ahocorasick.Automaton()
        for t, w in self.terms.items():
            # A whole word stands between spaces, a stem behind one.
            pattern = f" {t[:-1]}" if t.endswith(STEM) else f" {t} "
            self.automaton.add_word(pattern, (len(pattern), w))
        for e in self.exceptions:
            self.automaton.add_word(f" {e} ", (len(e) + 2, None))
        if self.terms:
            self.automaton.make_automaton()

    def matches(self, words: list[str]) -> dict[int, float]:
        """Place -> weight of the words that match, the largest where several terms do, without those inside an exception phrase."""
        if not self.terms:
            return {}
        found = [(end - n + 1, end, w) for end, (n, w) in self.automaton.iter(f" {' '.join(words)} ")]
        spared = [(s, e) for s, e, w in found if w is None]
        hits: dict[int, float] = {}
        for s, e, w in found:
            if w is not None and not any(a <= s and e <= b for a, b in spared):
                hits[s] = max(w, hits.get(s, w))
        return hits

    def measure(self, text: str) -> float:
        """Summed weight, normalised by length."""
        words = folded_words(text)
        total = sum(self.matches(words).values())
        return total / math.log2(2 + len(words)) if total else 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * self.measure(text)))))


def _terms(words: list[str]) -> set[str]:
    plain = {w for w in words if len(w) > 2}
    return plain | {w[:n] + STEM for w in plain for n in STEMS if len(w) > n}


def _origin(words: list[str]) -> int:
    """The smallest hash of two neighbouring words: mostly the same for near copies."""
    return min((xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)), default=0) >> 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of term and origin of toxic documents; of clean ones, the number with each term, as far as one task sees them."""
    clean: Counter = Counter()

    def out(terms: list, origins: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(origins, pa.int64()), pa.array(counts, pa.int64())], ["term", "origin", "clean"])

    for b in small_batches(batches):
        toxic: list[tuple[str, int]] = []
        for text, label in zip(texts_of(b), b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
            words = folded_words(text)
            if label:
                origin = _origin(words)
                toxic += [(t, origin) for t in _terms(words)]
            else:
                clean.update(_terms(words))
        yield out([t for t, _ in toxic], [o for _, o in toxic], [0] * len(toxic))
        if len(clean) > 200_000:
            yield out(list(clean), [None] * len(clean), list(clean.values()))
            clean.clear()
    yield out(list(clean), [None] * len(clean), list(clean.values()))


def _phrases(lexicon_terms: dict[str, float]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for text, label in zip(texts_of(b), b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
                w = folded_words(text)
                at = [i for i, x in enumerate(w) if x in lexicon_terms or x[:4] + STEM in lexicon_terms or x[:5] + STEM in lexicon_terms]
                rows += [(p, int(label)) for p in {" ".join(w[max(0, j) : j + 2]) for i in at for j in (i - 1, i)} if " " in p]
                rows += [("", int(label))] * bool(at)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["phrase", "toxic"])

    return count


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """text and toxic of the rows that labels cover; of several labels of a doc_id the largest counts.

    Labels are broadcast up to a counted number of rows, of two numbers each (some 32 MB as a hash table), beyond that the join shuffles.
    """
    by_id = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_id = by_id.select(F.col("doc_id").alias(f"{OWN}id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    side = F.broadcast(by_id) if labels.count() <= broadcast_rows else by_id
    return docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col(f"{OWN}id")).select("doc_id", "text", "toxic")


def learned(train: DataFrame, base: dict[str, float] | None = None) -> Lexicon:
    """A lexicon from rows of doc_id, text and toxic."""
    base = BASE if base is None else base
    totals = train.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(base)
    rows = train.select("text", "toxic").mapInArrow(_counted, "term string, origin long, clean long")
    # One row for each term and origin first, the clean documents' sums having none: texts are folded once for both counts.
    origins = rows.groupBy("term", "origin").agg(F.sum("clean").alias("clean")).groupBy("term").agg(F.count("origin").alias("toxic"), F.sum("clean").alias("clean"))
    uses = F.col("clean")
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((uses + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (uses + 0.5))
    chosen = origins.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= MIN_SHARE * n_toxic)).withColumn("odds", odds)
    best = chosen.filter((F.col("odds") >= ODDS) & (F.log("odds") >= ERRORS * error)).orderBy("term").collect()
    terms = dict(base) | {r["term"]: math.log(r["odds"]) for r in best}
    phrases = train.select("text", "toxic").mapInArrow(_phrases(terms), "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    phrases = stored(phrases, "phrases")
    # The empty phrase counts the documents with a term.
    held = phrases.filter("phrase = ''").first()
    least = max(SUPPORT, MIN_SHARE * (held["n"] - held["toxic"])) if held else SUPPORT
    spared = phrases.filter((F.col("phrase") != "") & (F.col("n") - F.col("toxic") >= least) & (F.col("n") >= 5 * F.col("toxic"))).orderBy("phrase").collect()
    dropped(phrases)
    lexicon = Lexicon(terms, [r["phrase"] for r in spared])
    lexicon.slope, lexicon.intercept = _fit(train, lexicon, n_toxic + n_clean)
    return lexicon


def _fit(train: DataFrame, lexicon: Lexicon, rows: int) -> tuple[float, float]:
    """Slope and intercept of a logistic function on the different texts, about FIT_ROWS, of a hash-chosen sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.measure(t) for t in texts_of(b)], pa.float64()), b.column(b.schema.get_field_index("toxic")).cast(pa.int64())], ["x", "y"])

    share = min(1.0, FIT_ROWS / max(1, rows))
    while True:
        # A text with many copies counts once, or it would fill the sample.
        sample = train.select("text", "toxic").filter(in_sample(F.xxhash64("text"), share)).distinct()
        got = sample.mapInArrow(measure, "x double, y long").toPandas()
        # Where nearly all rows are copies of a few texts the share may hold none: a larger one then.
        if len(got) or share >= 1:
            break
        share = min(1.0, 16 * share)
    x, y = got["x"].to_numpy(), got["y"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return lexicon.slope, lexicon.intercept
    # Newton steps with a small ridge, so that separable labels give finite numbers.
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions, lexicon.slope, lexicon.intercept))
    made: dict[int, Lexicon] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made.setdefault(0, Lexicon(*shared.value))
        for b in small_batches(batches):
            scores = [own.score(t) for t in texts_of(b)]
            yield appended(b, ["score", "predicted"], [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())])

    return docs.mapInArrow(score, with_fields(docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())))


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out rows aren't looked at."""
    train = labelled(docs.filter(f"NOT ({HELD_OUT})"), labels.filter(f"NOT ({HELD_OUT})"))
    lexicon = learned(train)
    out = scored(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")
