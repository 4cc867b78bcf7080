"""Stored tables: directory, commits of several writers, change feed, columns, and what is kept."""

import os
import threading
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larder.operators import audits, upsert
from larder.operators.upsert import Bucket, Conflict


def keyed(spark, *rows):
    return spark.createDataFrame(rows, "barcode string, last_modified_unix long, v string")


def many(spark, n, revision=1, v="a", first=0):
    return spark.range(first, first + n).selectExpr("concat('k', id) AS barcode", f"{revision}L AS last_modified_unix", f"'{v}' AS v")


def values(spark, root, number=None):
    return {r["barcode"]: r["v"] for r in upsert.read(spark, root, number).collect()}


def files(root):
    return {str(p.parent.relative_to(root)) for p in Path(root).rglob("*.parquet")}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "t")


# The directory.


def test_every_hash_has_one_bucket(spark):
    """Buckets of several depths share out all hashes, and the number expression finds the right one."""
    buckets = [Bucket(1, 0), *Bucket(1, 1).split(1)[:1], *Bucket(2, 3).split(2)]
    assert sorted((b.depth, b.code) for b in buckets) == [(1, 0), (2, 1), (4, 3), (4, 7), (4, 11), (4, 15)]
    got = spark.range(-500, 500).select("id", upsert._number(F.col("id"), buckets).alias("b")).collect()
    by_number = {b.number: b for b in buckets}
    for r in got:
        b = by_number[r["b"]]
        assert r["id"] & ((1 << b.depth) - 1) == b.code


def test_buckets_are_split_as_they_grow(spark, root):
    """Five batches, most rows in the last two: no bucket is larger than it may be, each row is in the bucket of its hash."""
    total = 0
    for n, size in enumerate((50, 100, 400, 3000, 9000)):
        upsert.upsert(many(spark, size, first=total), root, bucket_rows=300)
        total += size
        m = upsert.manifest(spark, root)
        assert m.number == n + 1 and m.rows == total and max(b.rows for b in m.buckets) <= 300
        assert sum(2.0**-b.depth for b in m.buckets) == 1
    assert min(b.depth for b in m.buckets) > upsert.DEPTH
    for b in m.buckets[::7]:
        rows = upsert._read(spark, root, m, [b])
        assert rows.count() == b.rows and rows.filter(upsert._number(upsert._hash(m.schema, m.keys), m.buckets) != b.number).isEmpty()
    assert upsert.read(spark, root).distinct().count() == total


def test_an_overwrite_splits_at_once(spark, root):
    upsert.overwrite(many(spark, 5000), root, bucket_rows=100)
    m = upsert.manifest(spark, root)
    assert m.rows == 5000 and max(b.rows for b in m.buckets) <= 100 and upsert.read(spark, root).distinct().count() == 5000
    assert files(root) == m.folders


def test_no_task_writes_more_than_so_many_rows(spark, root):
    """A bucket of many rows is written by several tasks: a file is what one task writes of a bucket."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        wide = many(spark, 40_000).withColumn("v", F.sha2("barcode", 256)).repartition(32)
        upsert.upsert(wide, root)
        upsert.upsert(wide.withColumn("last_modified_unix", F.lit(2).cast("long")), root)
    finally:
        for k in small:
            spark.conf.unset(k)
    m = upsert.manifest(spark, root)
    per_file = spark.read.parquet(*[f"{root}/{f}" for f in m.folders]).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per_file) == 40_000
    assert len(per_file) > 2 * len(m.buckets) and max(r["count"] for r in per_file) <= 1500


def test_untouched_buckets_stay_where_they_are(spark, root):
    upsert.upsert(many(spark, 200), root)
    before = upsert.manifest(spark, root)
    for n in range(2, 6):
        upsert.upsert(keyed(spark, ("k7", n, "b"), ("new", n, "c")), root, keep=2)
    after = upsert.manifest(spark, root)
    assert len(set(before.buckets) - set(after.buckets)) <= 2 and upsert.read(spark, root).count() == 201
    assert upsert.versions(spark, root) == [4, 5]
    # Nothing is left but what the last two versions name.
    assert files(root) == before.folders & after.folders | upsert.manifest(spark, root, 4).folders | after.folders
    assert upsert.overwrite(keyed(spark), root) == 6 and upsert.read(spark, root).count() == 0
    with pytest.raises(ValueError, match="kept by"):
        upsert.upsert(keyed(spark, ("a", 1, "x")), root, ["v"])


def test_keys_of_any_width_are_the_same(spark, root):
    upsert.upsert(spark.range(100).selectExpr("CAST(id AS INT) AS k", "1 AS v"), root, ["k"], guarded=False)
    upsert.upsert(spark.range(50, 150).selectExpr("id AS k", "2 AS v"), root, ["k"], guarded=False)
    got = {r["k"]: r["v"] for r in upsert.read(spark, root).collect()}
    assert got == {k: 1 if k < 50 else 2 for k in range(150)}
    assert dict(upsert.read(spark, root).dtypes)["k"] == "bigint"


# Several writers.


def test_a_crash_before_the_manifest_changes_nothing(spark, root, monkeypatch):
    upsert.upsert(many(spark, 50), root)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(upsert, "_published", crash)
        with pytest.raises(OSError, match="lost"):
            upsert.upsert(keyed(spark, ("k1", 2, "b")), root)
        with pytest.raises(OSError, match="lost"):
            upsert.overwrite(keyed(spark, ("k1", 2, "b")), root)
    assert upsert.version(spark, root) == 1 and set(values(spark, root).values()) == {"a"}
    assert upsert.upsert(keyed(spark, ("k1", 2, "c")), root) == 2
    assert values(spark, root) == {f"k{i}": "c" if i == 1 else "a" for i in range(50)}
    # What the crashed writers left goes by its age, not before.
    left = files(root) - upsert.manifest(spark, root).folders - upsert.manifest(spark, root, 1).folders
    assert left and not upsert.vacuum(spark, root)
    assert files(root) >= left
    assert upsert.vacuum(spark, root, hours=-1)
    assert files(root) == upsert.manifest(spark, root).folders | upsert.manifest(spark, root, 1).folders
    assert len(values(spark, root)) == len(values(spark, root, 1)) == 50


@pytest.mark.parametrize("second", [[("k3", 2, "b"), ("n1", 1, "b")], [(f"k{i}", 3, "b") for i in range(40)]])
def test_a_commit_between_merge_and_commit_keeps_both(spark, root, monkeypatch, second):
    """The first writer has made its folders when another commits and cleans up: on other buckets, or on the same ones."""
    upsert.upsert(many(spark, 40), root, keep=1)
    real, turns = upsert._merge, []

    def merge(*args):
        done = real(*args)
        turns.append(1)
        if len(turns) == 1:
            for _ in range(2):
                upsert.upsert(keyed(spark, *second), root, keep=1)
        return done

    monkeypatch.setattr(upsert, "_merge", merge)
    assert upsert.upsert(keyed(spark, ("k7", 2, "c"), ("n2", 1, "c")), root, keep=1) == 4
    expected = {f"k{i}": "a" for i in range(40)} | {"k7": "c", "n2": "c"} | {k: v for k, r, v in second if (k, r) != ("k7", 1)}
    assert values(spark, root) == expected


def test_writers_at_once_all_keep_their_rows(spark, root):
    upsert.upsert(many(spark, 20), root)
    failed = []

    def write(n):
        try:
            for i in range(3):
                upsert.upsert(many(spark, 15, 2 + n, f"w{n}", 100 * n + 5 * i), root, keep=3)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = values(spark, root)
    assert got == {f"k{i}": "a" for i in range(20)} | {f"k{100 * n + i}": f"w{n}" for n in range(4) for i in range(25)}
    assert upsert.version(spark, root) == 13 and upsert.versions(spark, root) == [11, 12, 13]


def test_tables_made_at_once(spark, root, monkeypatch):
    """Two writers find no table: the second merges into the first one's."""
    real, turns = upsert.overwrite, []

    def overwrite(*args):
        turns.append(1)
        if len(turns) == 1:
            upsert.upsert(keyed(spark, ("a", 1, "first"), ("b", 2, "first")), root)
            monkeypatch.setattr(upsert, "version", lambda *_: None)
            try:
                return real(*args)
            finally:
                monkeypatch.undo()
        return real(*args)

    monkeypatch.setattr(upsert, "overwrite", overwrite)
    upsert.upsert(keyed(spark, ("b", 1, "second"), ("c", 1, "second")), root)
    assert values(spark, root) == {"a": "first", "b": "first", "c": "second"}


def test_an_overwrite_doesnt_undo_others(spark, root, monkeypatch):
    upsert.upsert(keyed(spark, ("a", 1, "x")), root)
    real = upsert._write

    def write(*args):
        monkeypatch.undo()
        upsert.upsert(keyed(spark, ("b", 1, "y")), root)
        return real(*args)

    monkeypatch.setattr(upsert, "_write", write)
    with pytest.raises(Conflict, match="someone else"):
        upsert.overwrite(keyed(spark, ("a", 2, "z")), root)
    assert values(spark, root) == {"a": "x", "b": "y"}
    assert files(root) == set().union(*[upsert.manifest(spark, root, n).folders for n in upsert.versions(spark, root)])


def test_a_number_is_given_once(spark, root):
    upsert.upsert(keyed(spark, ("a", 1, "x")), root)
    m = upsert.manifest(spark, root)
    assert upsert._published(spark, root, replace(m, number=2)) and not upsert._published(spark, root, replace(m, number=2, buckets=()))
    assert upsert.manifest(spark, root) == replace(m, number=2)
    assert not [n for n in os.listdir(f"{root}/_manifests") if n.startswith(".2")]


def test_expected_properties(spark, root):
    upsert.upsert(keyed(spark, ("a", 1, "x")), root, properties={"at": "1"})
    upsert.upsert(keyed(spark, ("b", 1, "x")), root, properties={"at": "2"}, expected={"at": "1"})
    with pytest.raises(Conflict):
        upsert.upsert(keyed(spark, ("c", 1, "x")), root, properties={"at": "2"}, expected={"at": "1"})
    assert set(values(spark, root)) == {"a", "b"} and upsert.manifest(spark, root).properties == {"at": "2"}


# Columns.


def test_columns_are_added_renamed_and_widened(spark, root):
    upsert.upsert(spark.createDataFrame([("a", 1, 5, 1.5), ("b", 1, 6, 2.5)], "barcode string, last_modified_unix long, n int, x float"), root)
    upsert.upsert(spark.createDataFrame([("b", 2, 7, 3.5, "new"), ("c", 1, 8, 4.5, None)], "barcode string, last_modified_unix long, n int, x float, w string"), root)
    assert upsert.rename(spark, root, "n", "amount") == 3
    upsert.upsert(spark.createDataFrame([("c", 2, 1 << 40, 0.1), ("d", 1, 9, 0.2)], "barcode string, last_modified_unix long, amount long, x double"), root)
    rows = upsert.read(spark, root)
    assert rows.dtypes == [("barcode", "string"), ("last_modified_unix", "bigint"), ("amount", "bigint"), ("x", "double"), ("w", "string")]
    assert {tuple(r) for r in rows.collect()} == {("a", 1, 5, 1.5, None), ("b", 2, 7, 3.5, "new"), ("c", 2, 1 << 40, 0.1, None), ("d", 1, 9, 0.2, None)}
    # A column that takes an old name is another column.
    upsert.upsert(spark.createDataFrame([("e", 1, "text")], "barcode string, last_modified_unix long, n string"), root)
    assert upsert.read(spark, root).filter("barcode = 'a'").first()["n"] is None
    with pytest.raises(ValueError, match="in the table"):
        upsert.upsert(spark.createDataFrame([("e", 1, "text")], "barcode string, last_modified_unix long, amount string"), root)
    with pytest.raises(ValueError):
        upsert.rename(spark, root, "gone", "y")
    with pytest.raises(ValueError):
        upsert.rename(spark, root, "x", "w")


def test_renamed_keys(spark, root):
    upsert.upsert(keyed(spark, ("a", 1, "x"), ("b", 1, "y")), root)
    upsert.rename(spark, root, "barcode", "code")
    upsert.upsert(keyed(spark, ("b", 2, "z")).withColumnRenamed("barcode", "code"), root, ["code"])
    assert {r["code"]: r["v"] for r in upsert.read(spark, root).collect()} == {"a": "x", "b": "z"}


# The change feed.


def feed(spark, root, since, until=None):
    return sorted((r["barcode"], r["v"], r["change"]) for r in upsert.changes(spark, root, since, until).collect())


def test_feed_tells_what_changed(spark, root):
    upsert.upsert(keyed(spark, ("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)), root)
    upsert.upsert(keyed(spark, ("a", 2, "new"), ("b", 0, "older"), ("d", 1, "z")), root)
    upsert.upsert(keyed(spark, ("c", 1, None), ("d", 1, "z")), root)
    assert feed(spark, root, 1, 2) == [("a", "new", "after"), ("a", "x", "before"), ("d", "z", "inserted")]
    assert feed(spark, root, 2, 3) == [] and feed(spark, root, 1) == feed(spark, root, 1, 2) and feed(spark, root, 3) == []
    assert upsert.changes(spark, root, None, 1).filter("change = 'inserted'").count() == 3
    upsert.overwrite(keyed(spark, ("a", 2, "new")), root)
    assert {(r["barcode"], r["change"]) for r in upsert.changes(spark, root, 3).collect()} == {("b", "deleted"), ("c", "deleted"), ("d", "deleted")}


def test_feed_over_splits_and_new_columns(spark, root):
    upsert.upsert(many(spark, 200), root, bucket_rows=50)
    upsert.upsert(many(spark, 1500, 2, "b", 190).withColumn("w", F.lit(1)), root, bucket_rows=50)
    n = {r["change"]: r["count"] for r in upsert.changes(spark, root, 1).groupBy("change").count().collect()}
    assert n == {"inserted": 1490, "before": 10, "after": 10}


def test_feed_reads_changed_buckets_only(spark, root):
    upsert.upsert(many(spark, 400), root)
    upsert.upsert(keyed(spark, ("k7", 2, "b")), root)
    read = {f.rsplit("/", 1)[0] for f in upsert.changes(spark, root, 1).inputFiles()}
    assert len(read) == 2


# The audit from the feed.


SILVER = "barcode string, last_modified_unix long, ingest_run_id string, ingested_at timestamp, silver_processed_at timestamp, primary_brand string, primary_category string, primary_country string, nutriscore_grade_mismatch boolean, energy_kcal_per_100g double, proteins_100g double, sugars_100g double, nova_group int, nutriscore_grade_reported string, sugar_tier string"


def test_audit_subtracts_and_adds(spark, tmp_path):
    """Rows move from run to run, runs lose their only row of a brand, their earliest time and their last row; a version is skipped."""
    import random
    from datetime import datetime

    from larder.operators import gold

    rng, root, state = random.Random(5), str(tmp_path / "silver"), str(tmp_path / "state")
    some = lambda *xs: rng.choice(xs)

    def row(code, revision):
        run = some("r1", "r2", "r3", None)
        return (code, revision, run, datetime(2024, 1, rng.randrange(1, 9)), datetime(2024, 2, rng.randrange(1, 9)), some("a", "b", None), some("x", "y"), "z", some(True, False, None), some(1.0, None), some(1.0, None), some(2.0, None), some(1, 2, 3, 4, None), some("A", "E", "Unknown"), some("Low", "High"))

    built = F.lit("2024-03-01").cast("timestamp")
    for batch in range(5):
        codes = rng.sample(range(30), 12)
        rows = [row(str(10**9 + c) if c % 3 else f"x{c}", batch) for c in codes]
        upsert.upsert(spark.createDataFrame(rows, SILVER), root, keep=2)
        if batch == 2:
            continue
        if batch == 4:
            upsert.upsert(spark.createDataFrame(rows[:1], SILVER), root, keep=1)
        version = audits.refresh(spark, root, state)
        assert audits.refresh(spark, root, state) == version == upsert.version(spark, root)
        expected = gold.audit(upsert.read(spark, root), built)
        got = audits.audit(upsert.read(spark, state), built)
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_a_refresh_is_counted_once(spark, tmp_path, monkeypatch):
    from datetime import datetime

    root, state = str(tmp_path / "silver"), str(tmp_path / "state")
    rows = lambda n: spark.createDataFrame([(str(10**9 + n), 1, "r1", datetime(2024, 1, 1), datetime(2024, 1, 1), "a", "x", "z", True, 1.0, 1.0, 1.0, 1, "A", "Low")], SILVER)
    upsert.upsert(rows(1), root)
    audits.refresh(spark, root, state)
    upsert.upsert(rows(2), root)
    real = upsert._merge

    def merge(*args):
        done = real(*args)
        monkeypatch.undo()
        audits.refresh(spark, root, state)
        return done

    monkeypatch.setattr(upsert, "_merge", merge)
    with pytest.raises(Conflict):
        audits.refresh(spark, root, state)
    assert audits.audit(upsert.read(spark, state)).first()["total_products_processed"] == 2


# Zones and key lookups.


def run_rows(spark, first, n, run):
    return spark.range(first, first + n).selectExpr("concat('k', id) AS barcode", f"{run[1:]}L AS last_modified_unix", f"'{run}' AS run")


def read_folders(df):
    return {str(Path(f).parent) for f in df.inputFiles()}


def test_rows_of_a_run_are_read_from_its_folders_only(spark, root):
    upsert.upsert(run_rows(spark, 0, 2000, "r1"), root, bucket_rows=100, zones=["run"])
    for k, run in enumerate(("r2", "r3")):
        upsert.upsert(run_rows(spark, 3000 + k, 1, run), root, bucket_rows=100)
    m = upsert.manifest(spark, root)
    one = upsert.selected(spark, root, {"run": ("r3", "r3")})
    assert [r["barcode"] for r in one.collect()] == ["k3001"] and len(read_folders(one)) == 1 < len(m.folders)
    assert upsert.selected(spark, root, {"run": ("r2", None)}).count() == 2 and upsert.selected(spark, root, {"run": (None, "r1")}).count() == 2000
    none = upsert.selected(spark, root, {"run": ("r4", "r5")})
    assert none.isEmpty() and none.columns == one.columns and not none.inputFiles()
    # A column without zones is filtered all the same, also together with one that has them; names follow a rename.
    assert upsert.selected(spark, root, {"barcode": ("k1", "k10")}).count() == 2
    upsert.rename(spark, root, "run", "batch")
    both = upsert.selected(spark, root, {"batch": ("r3", None), "barcode": ("k3", None)})
    assert both.count() == 1 and len(read_folders(both)) == 1
    assert upsert.selected(spark, root, {"run": ("r1", "r1")}, number=1).count() == 2000


def test_zones_of_every_type_skip_nothing_that_counts(spark, root):
    """Each row is found by each of its values, whatever the order of types, nulls and long texts."""
    rows = spark.range(40).selectExpr(
        "concat('k', id) AS barcode", "1L AS last_modified_unix", "CAST(nullif(id - 20, 3) AS SMALLINT) AS whole", "date_add(DATE'1969-12-20', CAST(id AS INT)) AS day",
        "timestamp_micros(id * 7777777 - 100000000) AS at", "TIMESTAMP_NTZ'1969-12-30 23:00:00' + make_dt_interval(0, CAST(id AS INT)) AS local",
        f"CASE WHEN id % 3 > 0 THEN concat(repeat('x', {upsert.ZONE_SIGNS}), char(64 + id)) WHEN id > 5 THEN '\U0001F600\uFFFD' ELSE '' END AS text", "CAST(NULL AS STRING) AS nothing",
    )
    names = ["whole", "day", "at", "local", "text", "nothing"]
    upsert.upsert(rows, root, bucket_rows=3, zones=names)
    got = upsert.read(spark, root).collect()
    for name in names[:-1]:
        for r in got[:: 7 if name != "text" else 3]:
            if r[name] is not None:
                same = upsert.selected(spark, root, {name: (r[name], r[name])}).collect()
                assert {x["barcode"] for x in same} == {x["barcode"] for x in got if x[name] == r[name]}
    part = upsert.selected(spark, root, {"whole": (15, None)})
    assert part.count() == 5 and len(read_folders(part)) <= 5 < len(upsert.manifest(spark, root).folders)
    assert not upsert.selected(spark, root, {"nothing": (None, None)}).inputFiles()
    with pytest.raises(ValueError, match="zones"):
        upsert.overwrite(rows.withColumn("x", F.lit(1.0)), root, zones=["x"])


def test_zones_of_a_table_that_had_none(spark, root):
    """Folders written before are read; an overwrite keeps the zones."""
    upsert.upsert(run_rows(spark, 0, 300, "r1"), root)
    old = upsert.manifest(spark, root).folders
    upsert.zone(spark, root, "run")
    upsert.upsert(run_rows(spark, 1000, 1, "r2"), root)
    one = upsert.selected(spark, root, {"run": ("r2", "r2")})
    assert one.count() == 1 and len(read_folders(one)) == len(old)
    upsert.overwrite(upsert.read(spark, root), root)
    one = upsert.selected(spark, root, {"run": ("r2", "r2")})
    assert one.count() == 1 and len(read_folders(one)) == 1
    # A type without places has no zones any more; everything is read.
    upsert.overwrite(upsert.read(spark, root).withColumn("run", F.substring("run", 2, 1).cast("double")), root)
    assert upsert.selected(spark, root, {"run": (2, 2)}).count() == 1


def test_keys_are_looked_up_in_their_buckets(spark, root):
    upsert.upsert(many(spark, 3000), root, bucket_rows=100)
    wanted = keyed(spark, ("k7", 9, "ignored"), ("k7", 9, "twice"), ("k99", 9, "x"), ("absent", 9, "x"), (None, 9, "x"))
    rows = upsert.found(wanted, root)
    assert sorted(r["barcode"] for r in rows.collect()) == ["k7", "k99"] and {r["v"] for r in rows.collect()} == {"a"}
    looked = {f for f in read_folders(rows) if root in f}
    assert len(looked) <= 3 < len(upsert.manifest(spark, root).folders)
    assert upsert.found(wanted.limit(0), root).isEmpty()


def test_guarded_merges_deal_rows_out_once(spark, tmp_path, monkeypatch):
    """By buckets of several depths and slices of them: the rows of merged_latest, no shuffle but one; a first upsert splits its buckets before it writes."""
    writes, saved = [], upsert._saved
    monkeypatch.setattr(upsert, "_saved", lambda dealt, *more: writes.append(dealt) or saved(dealt, *more))
    monkeypatch.setattr(upsert, "SLICE_ROWS", 7)
    side = lambda n, step, at: spark.range(0, n, step).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), ((F.col("id") * 7) % 5 + at).alias("at"), F.concat(F.lit(f"{at}-"), "id").alias("v"))
    old, new, root = side(600, 1, 0), side(900, 2, 1), str(tmp_path / "t")
    for rows in (old, new):
        upsert.upsert(rows, root, ["k"], revision="at", bucket_rows=40)
    got = upsert.read(spark, root)
    assert len({b.depth for b in upsert.manifest(spark, root).buckets}) > 1
    assert sorted(map(str, got.collect())) == sorted(map(str, upsert.merged_latest(old, new, ["k"], "at").collect()))
    assert len(writes) == 2
    plan = writes[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
