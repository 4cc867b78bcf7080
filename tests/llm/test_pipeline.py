import math
from collections import Counter

import corpus_pipeline
from larder.llm import quality
from larder.llm.common import stored
from tests.llm.conftest import CLASHING, LONG, frame
from tests.llm.test_exact_dedup import TABLE
from tests.llm.test_mixing import brute as mixed_brute
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import ids_of, verify  # noqa: F401


def test_stages_against_brute_force(spark, tiny, ids_of):  # noqa: F811
    """Each stage's decisions on what the one before it kept."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in docs.collect()]
        out = stage(spark, docs, tiny)
        if name == "packing":
            n = verify(out.collect(), [r[:2] for r in before], ids_of)
            assert n <= math.ceil(sum(len(ids_of(r[1])) for r in before) / 2048) + 1
            break
        assert out.columns == columns, name
        docs = stored(out, name)
        after = [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in docs.collect()]
        if name == "quality":
            accepted = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{tiny}/documents.parquet")).collect() if r["accepted"]}
            assert {r[0] for r in after} == accepted and 0 < len(after) < len(before)
        elif name == "exact":
            keep = {}
            for r in before:
                t = (r[1] or "").translate(TABLE)
                keep[t] = max(keep.get(t, r[0]), r[0])
            assert sorted(r[0] for r in after) == sorted(keep.values())
        elif name == "near":
            assert {r[0] for r in after} == {i for i, (_, _, k) in near_brute(before, 80).items() if k}
        elif name == "mixing":
            assert Counter(r[0] for r in after) == Counter(i for (i, _, _), n in mixed_brute(before).items() for _ in range(n))


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50


def test_empty_table(spark):
    docs = frame(spark, [], clash=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        docs = stored(out, name) if name != "packing" else None


def test_rows_without_id(spark):
    """Such rows are kept by the stages that decide by id, and lost by none."""
    rows = [(None, f"This is text number {i}, with a few words of its own, like {i * 7} and {i * 13}. It goes on.", "en", "s") for i in range(20)]
    rows += [(i, f"Another text is number {i}, and says what it says, {i * 11} times. It ends here.", "en", "s") for i in range(20)]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.count() == 40, name
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, "")
        assert docs.count() > 0
        docs = stored(docs, name) if name != "packing" else None


def test_odd_columns_pass_through(spark):
    rows = [(i, f"This is text number {i}, with a few words of its own, like {i * 7} and {i * 13}. It goes on.", "en", "s") for i in range(50)]
    docs = frame(spark, rows, clash=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns[-len(CLASHING) :] == CLASHING, name
        assert all(r[c] == f"{c}!" for r in docs.collect() for c in CLASHING), name


def test_long_texts_ties_and_capitals(spark):
    """A very long text comes through whole, rows that tie in text and id leave one, of texts that differ in capitals the largest id stays."""
    good = [(i, f"This is text number {i}, with a few words of its own, like {i * 7} and {i * 13}. It goes on, and ends.", "en", "s") for i in range(30)]
    rows = [*good, good[3], good[3], (50, good[4][1].upper(), "en", "s"), (60, LONG, "en", "s"), (61, None, "en", "s"), (62, "", None, None)]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stored(stage(spark, docs, ""), name)
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "exact":
            assert ids == sorted({*range(30), 50, 60, 62} - {4})
    whole = docs.filter("doc_id = 60").first()["text"]
    assert whole == LONG
    packed = corpus_pipeline.packing_stage(spark, docs.filter("doc_id = 60"), "").collect()
    assert sum(r["length"] for r in packed) > 2048 * 10 and len({r["sequence_id"] for r in packed}) == len(packed)


def test_run_leaves_no_stage_tables(spark, tiny):
    from larder.storage import shared_folder

    corpus_pipeline.run(spark, tiny)
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [n for n in names if n.startswith("larder-stage-")]
