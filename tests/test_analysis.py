"""Ranks, distinct bitmaps, variants, gates while writing, the page source and the stateful stream on small fixtures."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators import distinct, gold, quality_gates, ranks, upsert, variants
from larder.session import ship
from larder.sources import page_source
from larder.sources.pages import Response
from larder.streaming import latest

# Ranks.


def plain_ranks(rows):
    out = {}
    for group, value in set(rows):
        mine = [v for g, v in rows if g == group]
        below = sum(1 for v in mine if (v is not None and value is None) or (v is not None and value is not None and v < value))
        out[group, value] = (below + 1, len(mine), round(below / (len(mine) - 1) * 100, 1) if len(mine) > 1 else None)
    return out


@pytest.mark.parametrize(("ranges", "few"), [(4, 0), (50, 10), (200, 10_000)])
def test_ranks_equal_a_plain_version(spark, ranges, few):
    """A group with a third of the rows, one value with a third of those, nulls as group and as value, a group of one."""
    rng = random.Random(ranges)
    rows = [("hot", 7.0 if rng.random() < 0.3 else rng.choice([None, round(rng.random(), 2)])) for _ in range(400)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, -2.5, float(rng.randrange(50))])) for _ in range(800)] + [("one", 1.0)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v double"), "g", "v", ranges, few).collect()
    assert len(got) == len(rows)
    expected = plain_ranks(rows)
    for r in got:
        rank, n, percentile = expected[r["g"], r["v"]]
        assert (r["rank"], r["n_in_group"]) == (rank, n) and r["percentile"] == pytest.approx(percentile, abs=0.101)


def test_no_window_over_a_group(spark):
    """Where a third of the rows has one group, no task of a window gets its rows: the largest range of values is a small part of it."""
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS g", "id AS v")
    by_value = ranks.value_ranks(rows, "g", "v", ranges=100, few=100)
    assert by_value.filter(f"{ranks.GROUP} = 'hot'").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 10_000, 10_000)
    plan = ranks.ranked(rows, "g", "v", 100, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


# Distinct counts.


def test_bitmaps_of_any_runs(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["r1", "r2", "r3", None]), rng.choice([None, *range(40_000)]), rng.choice("xyz")) for _ in range(3000)]
    bitmaps = distinct.run_bitmaps(spark.createDataFrame(rows, "run string, k long, s string"), {"k": "keys", "s": "signs"}, "run", bucket_values=500)
    for runs in (["r1"], ["r1", "r3"], ["r1", "r2", "r3"], ["other"]):
        mine = [(k, s) for r, k, s in rows if r in runs]
        got = distinct.counted(bitmaps.filter(F.col("run").isin(runs)), ["keys", "signs"]).first()
        assert tuple(got) == (len({k for k, _ in mine} - {None}), len({s for _, s in mine}))
    everything = distinct.counted(bitmaps, ["keys"], F.lit("all")).first()
    assert everything["unique_keys"] == len({k for _, k, _ in rows} - {None})


def test_dictionary_numbers_are_dense(spark):
    pairs = spark.range(5000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS name", "CAST(id AS STRING) AS value")
    got = distinct.dictionary(pairs, bucket_values=300)
    for name in "ab":
        assert sorted(r["number"] for r in got.filter(F.col("name") == name).collect()) == list(range(2500))


# Variants.


def test_variants_and_quarantine(spark):
    texts = ['{"a": 1, "b": {"c": "x"}, "l": [{"s": 1}, {"s": "two"}]}', '{"a": "no number"}', "[1, 2]", '{"a": 1', "", None, "7"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    good, broken = variants.split(rows, "j")
    assert {r["id"]: r["j"] for r in broken.collect()} == {3: texts[3], 4: ""} and broken.columns == ["id", "j"]
    got = {r["id"]: (r["a"], r["c"]) for r in variants.fields(good, {"a": ("$.a", "int"), "c": ("$.b.c", "string")}).collect()}
    assert got == {0: (1, "x"), 1: (None, None), 2: (None, None), 5: (None, None), 6: (None, None)}
    items = variants.elements(good, "$.l", "id").select("id", "position", F.try_variant_get("element", "$.s", "int").alias("s"))
    assert sorted(tuple(r) for r in items.collect()) == sorted([(0, 0, 1), (0, 1, None)], key=str)
    assert {(r["key"], r["n_rows"]) for r in variants.members(good.filter("id < 2")).groupBy("key").agg(F.sum("n_rows").alias("n_rows")).collect()} == {("a", 2), ("b", 1), ("l", 1)}
    assert "b: OBJECT<c: STRING>" in variants.schema(good.filter("id < 2")).first()["schema"]


# Gates.


def test_gates_cost_no_job(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "IF(id % 4 = 0, NULL, id) AS v")
    tracker = spark.sparkContext.statusTracker()

    def jobs(write):
        spark.sparkContext.setJobGroup(write.__name__, "")
        write()
        n = len(tracker.getJobIdsForGroup(write.__name__))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    found = {}

    def plain():
        upsert.overwrite(rows, str(tmp_path / "a"), keys=["id"])

    def gated():
        watched, counts = quality_gates.observed(rows, {"missing": F.col("v").isNull(), "large": F.col("v") > 989, "none": F.lit(None).cast("boolean")})
        upsert.overwrite(watched, str(tmp_path / "b"), keys=["id"])
        found.update(counts())

    assert jobs(plain) == jobs(gated) and found == {"missing": 250, "large": 8, "none": 0}
    assert set(gold.row_gates("fact_product_nutrition")) >= {"fact_product_nutrition.energy in range"} and gold.row_gates("pipeline_audit") == {}


# The page source.

DATA = [{"code": str(i)} for i in range(25)]
ASKED = []


def api(url, params):
    """A source of 25 products; a page that is asked for the first time is busy."""
    at = (params["page"] - 1) * params["page_size"]
    ASKED.append(params["page"])
    return Response(200, {"count": len(DATA), "products": DATA[at : at + params["page_size"]]})


def options(**more):
    return {"url": "https://source.example", "transport": "tests.test_analysis:api", "run_id": "r1", "records_per_page": "10", **more}


def test_a_page_is_a_partition(spark):
    ship(spark)
    page_source.register(spark)
    pages = spark.read.format("pages").options(**options(first="2", pages="4")).load()
    assert pages.rdd.getNumPartitions() == 4
    got = pages.orderBy("page_number").collect()
    # Pages 4 and 5 are beyond the end.
    assert [(r["page_number"], r["page_size"], r["total_products_reported"], r["ingest_run_id"]) for r in got] == [(2, 10, 25, "r1"), (3, 5, 25, "r1")]
    assert json.loads(got[1]["products"]) == DATA[20:]
    with pytest.raises(Exception, match="count from 1"):
        spark.read.format("pages").options(**options(pages="0")).load().count()


def test_long_windows_are_runs_of_pages():
    """Partitions grow far slower than pages, cover each page once in order, and give the pages' rows."""
    for first, pages in ((1, 3), (5, 64), (2, 127), (7, 130), (1, 999), (3, 36_001)):
        asked = page_source.Client(options(first=str(first), pages=str(pages)))
        batch = page_source.PageReader(asked).partitions()
        stream = page_source.PageStreamReader(asked).partitions({"next_page": first}, {"next_page": first + pages})
        for parts in (batch, stream):
            assert [p for r in parts for p in range(r.first, r.end)] == list(range(first, first + pages))
            assert len(parts) <= max(2 * page_source.SPREAD, -(-pages // page_source.RUN))
    assert page_source.runs(4, 4) == []
    assert [r[1] for r in page_source.Client(options()).rows(page_source.Pages(1, 9))] == [1, 2, 3]


def test_stream_offsets_are_pages(spark, tmp_path):
    """Started again, the stream asks for new pages only."""
    ship(spark)
    page_source.register(spark)
    folder = tmp_path / "landed"
    seen = []

    def land(first, last):
        for page in range(first, last + 1):
            (folder / f"page={page}").mkdir(parents=True)
            (folder / f"page={page}" / "part-0.txt").write_text("\n".join(json.dumps({"code": f"{page}-{i}"}) for i in range(10)))
        (folder / "count").mkdir(exist_ok=True)
        (folder / "count" / "part-0.txt").write_text(str(10 * last))

    def run():
        stream = spark.readStream.format("pages").options(**options(url=str(folder), transport="larder.sources.page_source:mounted")).load()
        stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r[0] for r in df.select("page_number").collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    land(1, 3)
    run()
    run()
    land(4, 5)
    run()
    assert [s for s in seen if s] == [[1, 2, 3], [4, 5]]


# The stateful stream.


def test_keep_latest_drops_late_rows_and_old_state(spark, tmp_path):
    """Newer rows win over batches and within one, ties by the next column; rows behind the watermark are left out."""
    ship(spark)
    folder, table, check = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    schema = "k string, at timestamp, n long"
    batches = [
        [("a", day(1), 1), ("a", day(2), 2), ("b", day(1), 1), ("b", day(1), 3)],
        [("a", day(1), 9), ("c", day(40), 1), ("b", day(1), 2)],
        [("d", day(1), 1), ("c", day(39), 5), ("a", day(41), 1)],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            latest.keep_latest(spark.readStream.schema(schema).parquet(folder), ["k"], "at", table, check, ["n"], late="10 days", live=86400).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r["k"]: (r["at"], r["n"]) for r in upsert.read(spark, table).collect()}
    assert got == {"a": (day(41), 1), "b": (day(1), 3), "c": (day(40), 1)}


class Counted:
    """A state handle that counts its calls; the state gives times without a zone, as Spark's does."""

    def __init__(self):
        self.calls, self.place, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.place

    def update(self, place):
        self.calls += 1
        self.place = tuple(v.astimezone().replace(tzinfo=None) if isinstance(v, datetime) else v for v in place)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_keep_latest_asks_little_for_a_key(spark):
    """A key's rows are plain rows, whose times have a zone; its state is read once and written with its timer when a row is newer."""
    handle, schema = Counted(), T.StructType.fromDDL("at timestamp, n double, k string")
    newest = latest.Newest(schema, ["at", "n"], 1000)
    newest.init(handle)
    at = lambda hour: datetime(2024, 1, 1, hour, tzinfo=timezone.utc)
    row = lambda hour, n: Row(at=None if hour is None else at(hour), n=n, k="a")
    give = lambda *rows: list(newest.handleInputRows(("a",), iter(rows), None))
    assert give(row(None, 5.0), row(3, float("nan")), row(3, 1.0), row(2, 9.0)) == [row(3, 1.0)]
    assert handle.calls == 3 and handle.timers == [int(at(3).timestamp() * 1000) + 1000]
    assert give(row(3, 1.0), row(3, float("nan")), row(2, 8.0)) == [] and handle.calls == 4
    assert give(row(3, 2.0)) == [row(3, 2.0)]
