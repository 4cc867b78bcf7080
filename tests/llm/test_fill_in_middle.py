"""Fill-in-middle samples against a plain version that cuts Python strings."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import fill_in_middle as M
from larder.llm import queries
from tests.helpers import assert_same
from tests.llm.conftest import frame

PATTERNS = {"char": r"(?s).", "word": r"(?s)[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+", "line": r"[^\n]*\n|[^\n]+"}
SPREAD = {"char": lambda t: re.findall(PATTERNS["char"], t), "line": lambda t: re.findall(PATTERNS["line"], t)}


def words(text):
    """Leading blanks are a unit of their own, as the first byte always begins one."""
    lead = re.match(r"[ \t\n\x0b\x0c\r]*", text)[0]
    return [*([lead] if lead else []), *re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text[len(lead) :])]


SPREAD["word"] = words


def plain_version(doc_id, text, unit="char", seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = SPREAD[unit](text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in M.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark, tiny):
    assert_same(queries.QUERIES["op13_fill_in_middle"](spark, tiny), queries.ORACLES["op13_fill_in_middle"], tiny)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_a_plain_version_and_gives_texts_back(spark, tiny, odd, no_id, unit):
    more = frame(spark, [(20 + i, t, "en", "a") for i, t in enumerate(["a<P>b", "<", "<P", "é" * 9, "😀😀\n\n😀", "  lead and\ttail \n", "x<S>" * 50, "<M", "\n"])])
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet"), odd, no_id, more):
        rows = M.restored(M.fill_in_middle(docs, unit)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(r.doc_id, r.text, unit)
            assert r.restored == (r.text or "")


def test_clashing_columns_and_empty_tables(spark, odd, empty):
    made = M.fill_in_middle(odd)
    assert made.columns.count("n") == 1 and made.schema["n"].dataType.simpleString() == "bigint"
    assert made.select("kept").distinct().first()[0] == "kept!"
    assert M.restored(M.fill_in_middle(empty)).collect() == []


def test_forms_are_drawn_in_the_asked_shares(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('words ', 30) AS text")
    n = {r.form: r["count"] for r in M.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 720) < 100
    assert {r.form for r in M.fill_in_middle(docs, plain_from=100, spm_below=0).select("form").distinct().collect()} == {"psm"}


@given(st.lists(st.text("ab é\n<PSM>", max_size=30), min_size=1, max_size=6), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_any_cut_of_any_text_comes_back(texts, i, j):
    import numpy as np

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for unit in M.BEGINS:
        sums, before, n = M.unit_counts(data, offsets, unit)
        assert n.tolist() == [len(SPREAD[unit](t)) for t in texts]
        cuts = np.sort(np.stack([i % (n + 1), j % (n + 1)]), axis=0)
        first, second = (M.places(sums, before, n, offsets, c) for c in cuts)
        for k, t in enumerate(texts):
            units, raw = SPREAD[unit](t), data.tobytes()
            assert raw[offsets[k] : first[k]].decode() == "".join(units[: cuts[0][k]])
            assert raw[first[k] : second[k]].decode() == "".join(units[cuts[0][k] : cuts[1][k]])
    held = M.holding(data, offsets, [s.encode() for s in M.SENTINELS])
    assert held.tolist() == [any(s in t for s in M.SENTINELS) for t in texts]


def test_sentinels_that_could_be_mistaken_are_refused(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "'a' AS text")
    for bad in (("<P>", "<P>x", "<M>"), ("a", "ba", "c"), ("", "b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            M.fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError):
        M.fill_in_middle(docs, unit="page")
