"""Pages through bronze, silver and gold, upserts, gates and the stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larder import storage
from larder.operators import bronze, gold, profiling, quality_gates, silver, upsert
from larder.sources import lookups, schemas
from larder.streaming import products as stream

def at():
    """A fixed time."""
    return F.timestamp_seconds(F.lit(1700000000))


DRINK = {
    "code": "20000017", "product_name": "oat drink", "brands": "North Farm, Other", "categories": "en:oat-drinks, Drinks", "countries": "France", "energy-kcal_100g": 120,
    "proteins_100g": 1.44, "sugars_100g": "20.5", "salt_100g": 0.107, "nutriscore_score": 19, "nutriscore_grade": "e", "nova_group": 4, "last_modified_t": 9, "extra": {"deep": [1]},
}


def page(folder, run, number, products):
    body = {"ingest_run_id": run, "api_page_number": number, "page_number": number, "page_size": len(products), "fetched_at": "2024-01-01T00:00:00+00:00", "source_url": "u", "total_products_reported": 9, "products": products}
    (folder / f"run_{run}_page_{number:06d}.json").write_text(json.dumps(body, indent=2))


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("france", "FR", "France"), ("us", "US", "United States"), ("en:guinea-bissau", "GW", "Guinea-Bissau")], schemas.LOOKUP)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / ".fetch_run_checkpoint.json").write_text("{}")
    page(folder, "r1", 1, [DRINK, {"code": None, "product_name": "no code"}, {"code": "5", "nova_group": "unknown", "countries": "zz", "last_modified_t": 5}])
    page(folder, "r1", 2, [DRINK | {"product_name": "old", "last_modified_t": 8}, {"code": "6", "energy_100g": "abc", "countries": "en:guinea-bissau", "last_modified_t": "7"}])
    return folder


def test_bronze_keeps_products_as_text(spark, landing):
    rows = bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at())
    assert rows.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.BRONZE.fields]
    got = rows.orderBy("page_number").collect()
    assert [r["page_size"] for r in got] == [3, 2] and json.loads(got[0]["raw_products_json"])[0]["extra"] == {"deep": [1]}


def test_bronze_append_is_idempotent_and_reads_one_run(spark, landing, tmp_path):
    rows = bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at())
    path = str(tmp_path / "bronze")
    bronze.append(rows, path)
    bronze.append(rows.withColumn("ingest_run_id", F.lit("r2")), path)
    bronze.append(rows, path)
    assert bronze.read(spark, path).count() == 4
    one = bronze.read(spark, path, "r1")
    assert one.count() == 2 and one.columns == schemas.BRONZE.names
    assert "PartitionFilters: [isnotnull(ingest_run_id" in one._jdf.queryExecution().toString()


def test_silver_end_to_end(spark, landing, lookup):
    rows = silver.run_silver(bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at()), lookup, "r1", processed_at=at())
    assert rows.columns == silver.SILVER_COLUMNS and len(rows.columns) == 45
    got = {r["barcode"]: r for r in rows.collect()}
    assert set(got) == {"20000017", "5", "6"}
    n = got["20000017"]
    assert (n["product_name"], n["primary_category"], n["primary_country"], n["country_iso_code"], n["primary_brand"]) == ("Oat Drink", "Oat Drinks", "France", "FR", "North Farm")
    assert (n["energy_kcal_per_100g"], n["salt_100g"], n["sodium_corrected_100g"], n["protein_density_score"]) == (120.0, 0.11, 0.04, 1.2)
    assert (n["nutriscore_grade_recalculated"], n["nutriscore_grade_mismatch"], n["nova_group_label"], n["sugar_tier"]) == ("E", False, "ultra_processed", "High")
    assert (got["5"]["country_iso_code"], got["5"]["primary_country"], got["5"]["nova_group"], got["5"]["data_quality_tier"]) == ("ZZ", "Unknown Country", None, "Sparse")
    assert got["6"]["primary_country"] == "Guinea-Bissau" and got["6"]["energy_raw_100g"] is None


def test_lookup_as_written_misses_tagged_aliases(spark, landing, lookup):
    rows = silver.silver(bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at()), lookup, at(), same_key=False)
    assert rows.filter("barcode = '6'").first()["country_iso_code"] == "XX"


def test_modes(spark, lookup, landing):
    rows = bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at())
    with pytest.raises(ValueError):
        silver.run_silver(rows, lookup)
    with pytest.raises(bronze.NoRows):
        silver.run_silver(rows, lookup, "other")
    assert silver.run_silver(rows, lookup, "other", backfill="yes", processed_at=at()).count() == 3
    with pytest.raises(bronze.NoRows):
        silver.run_silver(rows.withColumn("raw_products_json", F.lit("not json")), lookup, "r1")


def test_upsert_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "barcode string, last_modified_unix long, v string")
    with pytest.raises(FileNotFoundError):
        upsert.read(spark, root)
    assert upsert.upsert(rows(("a", 2, "x"), ("b", 1, "y")), root) == 1
    assert upsert.upsert(rows(("a", 1, "older"), ("c", 1, "z")), root) == 2
    now = {r["barcode"]: r["v"] for r in upsert.read(spark, root).collect()}
    assert now == {"a": "x", "b": "y", "c": "z"}
    upsert.upsert(rows(("a", 1, "older")), root, guarded=False)
    upsert.upsert(rows(("a", 1, "tie")), root)
    assert {r["barcode"]: r["v"] for r in upsert.read(spark, root).collect()} == {"a": "tie", "b": "y", "c": "z"}
    assert upsert.overwrite(upsert.read(spark, root).withColumn("w", F.lit(1)), root) == 5
    assert upsert.read(spark, root).columns[-1] == "w"


def test_gold_is_written_and_read_back(spark, lookup, landing, tmp_path):
    rows = silver_rows(spark, lookup, landing)
    grades = lookups.grade_lookup(spark)
    for _ in range(2):
        made = gold.materialised(rows, grades, str(tmp_path / "gold"), "2024-01-31", at())
    assert {n: df.count() for n, df in made.items()} == {"dim_product": 3, "dim_brand": 2, "dim_category": 2, "dim_country": 3, "dim_nutriscore": 6, "fact_product_nutrition": 3, "pipeline_audit": 1}
    assert upsert.version(spark, str(tmp_path / "gold" / "dim_brand")) == 2
    joined = gold.star(*[made[n] for n in ("fact_product_nutrition", "dim_product", "dim_brand", "dim_category", "dim_country", "dim_nutriscore")])
    assert joined.count() == 3


def test_rules_run_on_newest_revisions_only(spark, lookup):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "barcode string, last_modified_unix long")
    assert sorted((r[0], r[1]) for r in silver.newest(rows).collect()) == [("a", 2), ("a", 2), ("b", None)]
    plan = silver.newest(spark.range(10).selectExpr("cast(id as string) AS barcode", "id AS last_modified_unix"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hash") == 1


def silver_rows(spark, lookup, landing):
    return silver.silver(bronze.bronze(bronze.read_pages(spark, str(landing)), ingested_at=at()), lookup, at())


def test_gold_and_gates(spark, lookup, landing):
    rows = silver_rows(spark, lookup, landing).cache()
    fact = gold.fact_nutrition(rows, "2024-01-31", at())
    assert len(fact.columns) == 49
    product, brand, category, country = (f(rows, at()) for f in (gold.dim_product, gold.dim_brand, gold.dim_category, gold.dim_country))
    grades = gold.dim_nutriscore(lookups.grade_lookup(spark), at())
    assert len(product.columns) == 20 and len(gold.audit(rows, at()).columns) == 28 and grades.count() == 6
    got = {r["product_id"]: r for r in fact.collect()}
    assert got["20000017"]["healthiness_percentile"] is None and got["20000017"]["category_product_count"] == 1
    assert got["5"]["category_product_count"] == 2 and got["5"]["healthiness_rank_in_category"] == got["6"]["healthiness_rank_in_category"] == 1
    failed = quality_gates.failures(quality_gates.standard_gates(rows, fact, product, brand, category, country, grades))
    assert failed == {"silver.energy mostly known": 1, "silver.barcode mostly ean": 1}
    joined = gold.star(fact, product, brand, category, country, grades)
    assert joined.count() == 3
    audit = gold.audit(rows, at()).first()
    assert (audit["total_products_processed"], audit["missing_kcal_pct"], audit["invalid_ean_pct"]) == (3, 66.67, 66.67)
    health = profiling.run_health(gold.audit(rows, at()), F.timestamp_seconds(F.lit(1700003600))).first()
    assert (health["products_latest_run"], health["hours_since"]) == (3, 1.0)


def test_fact_window_plan_has_no_window_over_products(spark, lookup, landing):
    # Silver stored first: its own steps rank revisions.
    plan = gold.fact_nutrition(storage.stored(silver_rows(spark, lookup, landing), "silver"), "2024-01-31", at())._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan


def test_ranks_equal_windows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", None), ("a", None), ("b", 2)], "category_name string, nutriscore_score_raw int")
    got = {(r[0], r[1]): r[2] for r in gold.category_ranks(rows).collect()}
    assert got == {("a", 1): 1, ("a", 3): 3, ("a", None): 4, ("b", 2): 1}


def test_gates_find_violations(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (1, None, -1.0), (None, "z", None)], "k int, v string, m double")
    assert quality_gates.not_null(df, "k").count() == 1
    assert [tuple(r) for r in quality_gates.unique(df, "k").collect()] == [(1, 2)]
    assert quality_gates.accepted_values(df, "v", ["x"]).count() == 1
    assert quality_gates.in_range(df, "m", 0, 4).count() == 2
    assert quality_gates.relationships(df, "k", spark.createDataFrame([(2,)], "p int"), "p").count() == 2
    assert quality_gates.share_at_most(df, F.col("m") < 0, 0.3).first()["n_rows"] == 3
    assert quality_gates.share_at_most(df.limit(0), F.col("m") < 0, 0.3).isEmpty()


def test_stream_upserts_and_goes_on(spark, lookup, landing, tmp_path):
    table, check = str(tmp_path / "silver"), str(tmp_path / "check")
    stream.upsert_silver(stream.page_stream(spark, str(landing)), lookup, table, check, at()).awaitTermination()
    assert upsert.read(spark, table).count() == 3
    page(landing, "r2", 3, [{"code": "7", "last_modified_t": 1}, DRINK | {"product_name": "older", "last_modified_t": 1}])
    stream.upsert_silver(stream.page_stream(spark, str(landing)), lookup, table, check, at()).awaitTermination()
    now = {r["barcode"]: r["product_name"] for r in upsert.read(spark, table).collect()}
    assert set(now) == {"20000017", "5", "6", "7"} and now["20000017"] == "Oat Drink"


def test_stream_counts_by_hour(spark, landing):
    counted = stream.landed_per_hour(stream.page_stream(spark, str(landing)))
    query = counted.writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["n_pages"], r["n_products"]) for r in spark.table("by_hour").collect()] == [(2, 5)]


def test_lookups(spark, tmp_path):
    extra = tmp_path / "extra.csv"
    extra.write_text("alias,iso_code,display_name\n# no,XX,no\nHolland,nl,Netherlands\n", encoding="utf-8")
    countries = lookups.iso_countries(spark)
    assert len(countries) > 240 and ("FR", "France") in countries
    rows = lookups.alias_rows(countries, lookups.custom_rows(extra))
    assert ("holland", "NL", "Netherlands") in rows and ("en:united-kingdom", "GB", "United Kingdom") in rows
    assert lookups.custom_rows(tmp_path / "none.csv") == []
    called = {a: c for a, c, _ in lookups.alias_rows(countries, lookups.exonyms(spark, countries))}
    want = {"usa": "US", "deutschland": "DE", "österreich": "AT", "osterreich": "AT", "alemania": "DE", "frankrijk": "FR", "brasil": "BR", "england": "GB", "uk": "GB", "suomi": "FI", "россия": "RU", "world": "XX"}
    assert {a: called.get(a) for a in want} == want and called["france"] == "FR"
    lookups.write_lookup(tmp_path / "l.csv", rows)
    assert lookups.country_lookup(spark, str(tmp_path / "l.csv")).count() == len(rows)
    with pytest.raises(FileNotFoundError):
        lookups.country_lookup(spark, str(tmp_path / "missing.csv"))


def test_latest_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, None)], "barcode string, last_modified_unix long, v string")
    assert {tuple(r) for r in silver.latest(rows).collect()} == {("a", 1, "y"), ("b", None, None)}


def test_profiles(spark):
    df = spark.createDataFrame([("r1", 1.0, "a"), ("r2", None, "a"), ("r2", 250.0, "b")], "ingest_run_id string, m double, v string")
    assert profiling.of_run(df, "r1").count() == 1 and profiling.of_run(df).count() == 3
    assert profiling.latest_run(df).count() == 2
    assert {r["column_name"]: (r["n_missing"], r["missing_pct"]) for r in profiling.missing(df, ["m", "v"]).collect()} == {"m": (1, 33.33), "v": (0, 0.0)}
    assert [tuple(r) for r in profiling.top(df, ["v"], 1).collect()] == [("a", 2)]
    assert [tuple(r) for r in profiling.ambiguous(df, "ingest_run_id", "v").collect()] == [("r2", 2)]
    assert sorted(tuple(r) for r in profiling.histogram(df, "m", 100.0, 0.0, 900.0).collect()) == [(0.0, 1), (200.0, 1)]
    df.createOrReplaceTempView("profiled")
    assert profiling.described(df).count() == 3
    assert profiling.tables(spark, ["default", "no_such"]).columns == ["table_schema", "table_name", "table_type"]
    assert profiling.percentages(df, {"p": F.col("v") == "a"}).first()["p"] == 66.67
    assert isinstance(datetime.now(), datetime)
