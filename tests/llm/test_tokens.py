import random
from collections import Counter

import numpy as np
import pytest

from larder.llm import queries, token_counts
from larder.llm.tokens import default_vocabulary, encoder
from tests.llm.conftest import ROWS

SIGNS = [" ", "\n", " ", "a", "B", "é", "　", "1", "9", ".", "'s", "\t", "\r\n", "<|endoftext|>", "界", "½", "́", "👍", "the", " ", "​", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_library(plain):
    rng, encode = random.Random(3), encoder(default_vocabulary()).encode
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(14)))
        assert encode(text) == plain(text), repr(text)


def test_ids_of_documents(spark, tiny, plain):
    encode = encoder(default_vocabulary()).encode
    for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect():
        assert encode(r["text"]) == plain(r["text"])


def check(sums, lengths):
    n, total = len(lengths), sum(lengths)
    for r in sums:
        limit = r["context_limit"]
        assert r["n_docs"] == lengths.count(limit) and r["docs_at_least"] == sum(x >= limit for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= limit) and r["truncated_total"] == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in lengths) / n) and (r["total_docs"], r["total_tokens"]) == (n, total)
    assert {r["context_limit"] for r in sums} == set(lengths)


def test_odd_rows(odd, empty, plain):
    lengths = [len(plain(r[1] or "")) // 4 for r in ROWS]
    hist = token_counts.histogram(odd)
    assert {r["length"]: r["n_docs"] for r in hist.collect()} == Counter(lengths)
    sums = token_counts.suffix_sums(hist)
    check(sums.collect(), lengths)
    for limit in (1, 10, 500):
        assert token_counts.truncated_total(hist, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile_length(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.histogram(empty)).count() == 0
    assert token_counts.truncated_total(token_counts.histogram(empty), 5).first()[0] == 0


def test_rows_without_id(no_id, plain):
    rows = ["text without an id here and now"] * 2 + [""]
    assert {r["length"]: r["n_docs"] for r in token_counts.histogram(no_id).collect()} == Counter(len(plain(t)) // 4 for t in rows)


def test_query(spark, tiny, plain):
    lengths = [len(plain(r["text"] or "")) // 4 for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(queries.QUERIES["op5_token_counts"](spark, tiny).collect(), lengths)
