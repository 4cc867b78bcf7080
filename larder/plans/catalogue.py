"""Registered queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder import storage
from larder.functions import rules
from larder.operators import audits, bronze, distinct, gold, profiling, quality_gates, ranks, silver, upsert, variants
from larder.session import ship
from larder.sources import lookups, page_source, schemas
from larder.streaming import latest as latest_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A product feed made of the order tables, in the shape that silver has before its rules.

#: Aliases for the country tests: inline, so that both engines read the same rows.
ALIASES = [("france", "FR", "France"), ("deutschland", "DE", "Germany"), ("germany", "DE", "Germany"), ("en:united-states", "US", "United States"), ("us", "US", "United States")]
SNAPSHOT = "2024-01-31"

#: Exact decimal rounding in DuckDB, half up like Spark's.
def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,14)), {d}) AS DOUBLE)"


FEED_SQL = """
feed AS (
SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS barcode, CAST(epoch(l_shipdate) AS BIGINT) AS last_modified_unix,
  p_brand || ', Other' AS brands_raw, 'en:' || lower(p_type) || ', x' AS categories_raw, p_name AS product_name,
  CASE WHEN n_nationkey % 6 = 0 THEN 'en:france' WHEN n_nationkey % 6 = 1 THEN 'Deutschland, France' WHEN n_nationkey % 6 = 2 THEN 'zz'
    WHEN n_nationkey % 6 = 3 THEN 'en:united-states' WHEN n_nationkey % 6 = 4 THEN 'Nowhere Land' END AS countries_raw,
  l_extendedprice / CAST(100 AS DOUBLE) AS kcal, l_extendedprice / CAST(20 AS DOUBLE) AS kj, l_discount * CAST(1000 AS DOUBLE) AS sugars,
  l_quantity * CAST(2.5 AS DOUBLE) AS fat, l_tax * CAST(20 AS DOUBLE) AS salt, CAST(p_size AS DOUBLE) AS proteins,
  CAST(p_size AS INTEGER) - 10 AS score, CASE WHEN l_returnflag = 'A' THEN ' b' WHEN l_returnflag = 'N' THEN 'not-applicable' ELSE 'E' END AS grade,
  CAST(l_linenumber AS INTEGER) AS nova, strftime(l_shipdate, '%Y%m') AS ingest_run_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what a product's revision takes of them and of their suppliers' nations, as narrow rows."""
    measures = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
    line = table(spark, sf_dir, "lineitem").select(*measures)
    supplier, nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.drop("l_suppkey", "s_suppkey", "s_nationkey").withColumn("last_modified_unix", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))


def newest_revisions(lines: DataFrame) -> DataFrame:
    """The newest revisions of each part. A barcode's newest ones are among them, whichever parts it stands for, so the joins and
    rules behind get few rows; what has no supplier or nation is gone before, and all lines of a part find it or none does."""
    return silver.newest(lines, ["l_partkey"], "last_modified_unix")


def feed(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One row per order line (of those given): a product revision with raw text and raw measures. The small sides are broadcast if Spark finds them small."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    rows = (revisions(spark, sf_dir) if lines is None else lines).join(part, F.col("l_partkey") == F.col("p_partkey"))
    c, d = F.col, lambda x: F.lit(float(x))
    place = c("n_nationkey") % 6
    shipped = c("l_shipdate").cast("timestamp")
    return rows.select(
        F.lpad(c("l_partkey").cast("string"), 8, "0").alias("barcode"),
        "last_modified_unix",
        F.concat("p_brand", F.lit(", Other")).alias("brands_raw"),
        F.concat(F.lit("en:"), F.lower("p_type"), F.lit(", x")).alias("categories_raw"),
        c("p_name").alias("product_name"),
        F.when(place == 0, "en:france").when(place == 1, "Deutschland, France").when(place == 2, "zz").when(place == 3, "en:united-states").when(place == 4, "Nowhere Land").alias("countries_raw"),
        (c("l_extendedprice") / d(100)).alias("kcal"),
        (c("l_extendedprice") / d(20)).alias("kj"),
        (c("l_discount") * d(1000)).alias("sugars"),
        (c("l_quantity") * d(2.5)).alias("fat"),
        (c("l_tax") * d(20)).alias("salt"),
        c("p_size").cast("double").alias("proteins"),
        (c("p_size").cast("int") - 10).alias("score"),
        F.when(c("l_returnflag") == "A", " b").when(c("l_returnflag") == "N", "not-applicable").otherwise("E").alias("grade"),
        c("l_linenumber").cast("int").alias("nova"),
        F.date_format(shipped, "yyyyMM").alias("ingest_run_id"),
    )


def raw_silver(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The feed as the flat rows that the cleansing rules take."""
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)
    return feed(spark, sf_dir, lines).select(
        "barcode", "product_name", "brands_raw", "categories_raw", "countries_raw", none("string").alias("quantity_raw"), none("string").alias("serving_size_raw"),
        c("kj").alias("energy_raw_100g"), c("kcal").alias("energy_kcal_raw_100g"), c("proteins").alias("proteins_100g"), c("fat").alias("fat_100g"),
        none("double").alias("carbohydrates_100g"), c("sugars").alias("sugars_100g"), c("salt").alias("salt_100g"), none("double").alias("sodium_raw_100g"),
        none("double").alias("fiber_100g"), c("score").alias("nutriscore_score_raw"), c("grade").alias("nutriscore_grade_reported"), c("nova").alias("nova_group"),
        F.concat("product_name", F.lit(","), "brands_raw").alias("ingredients_text"), F.lit("en:milk,en:tree-nuts").alias("allergens"), none("string").alias("packaging"),
        "last_modified_unix", "ingest_run_id", F.timestamp_seconds("last_modified_unix").alias("ingested_at"),
    )


def inline_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, schemas.LOOKUP)


def silver_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed through all silver rules, latest revision per barcode; times are fixed, so results can be compared."""
    return refined_lines(spark, sf_dir, revisions(spark, sf_dir))


def refined_lines(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Order lines to silver: cut to each part's newest while they are narrow, then what the operator does with flat rows."""
    return silver.refined(raw_silver(spark, sf_dir, newest_revisions(lines)), inline_lookup(spark), fixed_time(), ties=TIES)


def fixed_time() -> Column:
    return F.timestamp_seconds(F.lit(1700000000))


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """silver_feed as a stored table, for queries that read it more than once."""
    return storage.stored(silver_feed(spark, sf_dir), "silver")


#: Enough columns to tell any two revisions of a product apart that differ in a result.
TIES = ["energy_kcal_raw_100g", "sugars_100g", "fat_100g", "salt_100g", "nova_group", "countries_raw", "nutriscore_grade_reported"]
_TIES_SQL = ", ".join(f"{c} DESC NULLS LAST" for c in ["kcal", *TIES[1:]])

_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_CAP = "CASE WHEN {0} >= 0 AND {0} <= 100 THEN {1} END"
_VALUES = ", ".join(f"('{a.removeprefix('en:').replace('-', ' ')}', '{i}', '{n}')" for a, i, n in ALIASES)

SILVER_SQL = FEED_SQL + f"""
, lookup(lookup_key, iso, name) AS (SELECT DISTINCT * FROM (VALUES {_VALUES}) t(k, i, n)),
codes AS (SELECT iso, min(name) AS iso_name FROM lookup GROUP BY iso),
keyed AS (SELECT *, regexp_replace(lower(replace(trim(regexp_replace(trim(string_split(countries_raw, ',')[1]), '^[a-zA-Z]{{2}}:', '')), '-', ' ')), '\\s+', ' ', 'g') AS ckey FROM feed),
placed AS (SELECT k.*, coalesce(l.iso, CASE WHEN regexp_matches(ckey, '^[a-z]{{2}}$') THEN upper(ckey) END, 'XX') AS country_iso_code, l.name AS alias_name
  FROM keyed k LEFT JOIN lookup l ON ckey = lookup_key),
named AS (SELECT p.*, coalesce(alias_name, iso_name, 'Unknown Country') AS primary_country FROM placed p LEFT JOIN codes c ON country_iso_code = c.iso),
clean AS (SELECT barcode, last_modified_unix, ingest_run_id, primary_country, country_iso_code, countries_raw, brands_raw, categories_raw, kcal, kj, product_name || ',' || brands_raw AS ingredients_text,
  {_TITLE.format("product_name")} AS product_name, {_TITLE.format("replace(regexp_replace(string_split(categories_raw, ',')[1], '^en:', ''), '-', ' ')")} AS primary_category,
  trim(string_split(brands_raw, ',')[1]) AS primary_brand,
  {_r("CASE WHEN kcal > 0 AND kcal <= 900 THEN kcal WHEN kj > 0 THEN " + _r("kj / 4.184e0", 1) + " WHEN kcal > 900 THEN " + _r("kcal / 4.184e0", 1) + " END", 1)} AS kcal_any,
  {_CAP.format("sugars", _r("sugars", 1))} AS sugars_100g, {_CAP.format("fat", _r("fat", 1))} AS fat_100g, {_CAP.format("salt", _r("salt", 2))} AS salt_100g,
  {_CAP.format("proteins", _r("proteins", 1))} AS proteins_100g, score AS nutriscore_score_raw,
  CASE WHEN trim(grade) = 'not-applicable' THEN 'Not Applicable' ELSE upper(trim(grade)) END AS nutriscore_grade_reported,
  CASE WHEN score <= -1 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 10 THEN 'C' WHEN score <= 18 THEN 'D' WHEN score IS NOT NULL THEN 'E' ELSE 'Unknown' END AS nutriscore_grade_recalculated,
  nova AS nova_group, CAST(len(string_split(product_name || ',' || brands_raw, ',')) AS INTEGER) AS ingredient_count
  FROM named),
limited AS (SELECT *, CASE WHEN kcal_any > 0 AND kcal_any <= 900 THEN kcal_any END AS energy_kcal_per_100g FROM clean),
derived AS (SELECT *,
  CASE WHEN salt_100g > 0 THEN {_r("salt_100g / 2.5e0", 2)} END AS sodium_corrected_100g,
  CASE WHEN sugars_100g IS NULL THEN 'Unknown' WHEN sugars_100g < 5 THEN 'Low' WHEN sugars_100g <= 12.5 THEN 'Medium' ELSE 'High' END AS sugar_tier,
  CASE WHEN fat_100g IS NULL THEN 'Unknown' WHEN fat_100g < 3 THEN 'Low' WHEN fat_100g <= 17.5 THEN 'Medium' ELSE 'High' END AS fat_tier,
  CASE WHEN salt_100g IS NULL THEN 'Unknown' WHEN salt_100g < 0.3 THEN 'Low' WHEN salt_100g <= 1.5 THEN 'Medium' ELSE 'High' END AS salt_tier,
  CASE WHEN energy_kcal_per_100g >= 5 AND proteins_100g > 0 AND proteins_100g <= 100 THEN {_r("proteins_100g / energy_kcal_per_100g * 100", 1)} END AS protein_density_score,
  CASE nova_group WHEN 1 THEN 'unprocessed' WHEN 2 THEN 'culinary_ingredient' WHEN 3 THEN 'processed' WHEN 4 THEN 'ultra_processed' ELSE 'unclassified' END AS nova_group_label,
  nutriscore_grade_reported IN ('A', 'B', 'C', 'D', 'E') AND nutriscore_grade_reported <> nutriscore_grade_recalculated AND nutriscore_grade_recalculated <> 'Unknown' AS nutriscore_grade_mismatch,
  regexp_matches(barcode, '^[0-9]{{8,14}}$') AS barcode_is_ean, sha256(barcode || '|' || last_modified_unix) AS row_hash,
  CAST(1 + 1 + 1 + (nova_group IS NOT NULL)::INT + (nutriscore_score_raw IS NOT NULL)::INT + (energy_kcal_per_100g IS NOT NULL)::INT + (proteins_100g IS NOT NULL)::INT
    + (fat_100g IS NOT NULL)::INT + (sugars_100g IS NOT NULL)::INT AS INTEGER) AS completeness_score,
  coalesce(energy_kcal_per_100g, proteins_100g, fat_100g, sugars_100g, salt_100g) IS NOT NULL AS is_nutritional_data_complete
  FROM limited),
ranked AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY last_modified_unix DESC NULLS LAST, {_TIES_SQL}) AS rn FROM derived),
silver AS (SELECT * EXCLUDE (rn), CASE WHEN completeness_score >= 6 THEN 'Complete' ELSE 'Sparse' END AS data_quality_tier FROM ranked WHERE rn = 1)
"""


# Silver and gold, end to end.

#: Silver's columns that the SQL above doesn't have by their names.
_FILLED = {
    "packaging": "'Unknown'", "allergens": "'Milk, Tree Nuts'", "ingested_at": "make_timestamp(last_modified_unix * 1000000)", "silver_processed_at": "make_timestamp(1700000000000000)",
    "quantity_raw": "CAST(NULL AS VARCHAR)", "serving_size_raw": "CAST(NULL AS VARCHAR)", "energy_raw_100g": "kj", "energy_kcal_raw_100g": "kcal",
    "carbohydrates_100g": "CAST(NULL AS DOUBLE)", "sodium_raw_100g": "CAST(NULL AS DOUBLE)", "fiber_100g": "CAST(NULL AS DOUBLE)",
}


def _filled(columns: Iterable[str]) -> str:
    return ", ".join(f"{_FILLED[c]} AS {c}" if c in _FILLED else c for c in columns)


def without_zones(df: DataFrame, *names: str) -> DataFrame:
    """Times without a zone, as both engines show them alike."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query(f"WITH {SILVER_SQL} SELECT {_filled(silver.SILVER_COLUMNS)} FROM silver")
def silver_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every silver rule over the feed, and the latest revision of each barcode: all columns."""
    return without_zones(silver_feed(spark, sf_dir), "ingested_at", "silver_processed_at")


_NOVA_TITLE = "CASE nova_group_label WHEN 'unclassified' THEN 'Unclassified' WHEN 'ultra_processed' THEN 'Ultra-processed' WHEN 'culinary_ingredient' THEN 'Culinary ingredient' WHEN 'unprocessed' THEN 'Unprocessed' WHEN 'processed' THEN 'Processed' END"
_AVG = lambda m, low, high: f"round(CAST(avg(CASE WHEN {m} {low} 0 AND {m} <= {high} THEN {m} END) AS DECIMAL(38,10)), 1)::DOUBLE"
_FLAG = lambda m, n: f"CASE WHEN {m} IS NULL OR category_avg_{n}_100g IS NULL THEN 'Unknown' WHEN {m} > category_avg_{n}_100g THEN 'Yes' ELSE 'No' END AS is_above_avg_{n}"

FACT_SQL = SILVER_SQL + f"""
, benchmarks AS (SELECT primary_category AS bc, {_AVG('energy_kcal_per_100g', '>', 900)} AS category_avg_kcal_100g, {_AVG('sugars_100g', '>=', 100)} AS category_avg_sugar_100g,
  {_AVG('fat_100g', '>=', 100)} AS category_avg_fat_100g, {_AVG('salt_100g', '>=', 100)} AS category_avg_salt_100g, {_AVG('proteins_100g', '>=', 100)} AS category_avg_protein_100g,
  count(*) AS category_product_count FROM silver GROUP BY 1),
fact AS (SELECT sha256(barcode) AS product_key, sha256(primary_brand) AS brand_key, sha256(primary_category) AS category_key, sha256(country_iso_code) AS country_key,
  sha256(CASE WHEN nutriscore_grade_reported IN ('A', 'B', 'C', 'D', 'E') THEN nutriscore_grade_reported ELSE 'Unknown' END) AS nutriscore_key, DATE '{SNAPSHOT}' AS snapshot_date,
  barcode AS product_id, primary_brand AS brand_name, primary_category AS category_name, primary_country AS country_name, country_iso_code, data_quality_tier, completeness_score,
  is_nutritional_data_complete, energy_kcal_per_100g, proteins_100g, fat_100g, sugars_100g, salt_100g, sodium_corrected_100g, protein_density_score, nutriscore_score_raw, ingredient_count, nova_group,
  {_NOVA_TITLE} AS nova_group_label, sugar_tier, fat_tier, salt_tier,
  CASE WHEN protein_density_score IS NULL THEN 'Unknown' WHEN protein_density_score >= 10 THEN 'High' WHEN protein_density_score >= 5 THEN 'Medium' ELSE 'Low' END AS protein_density_tier,
  category_avg_kcal_100g, category_avg_sugar_100g, category_avg_fat_100g, category_avg_salt_100g, category_avg_protein_100g,
  {_FLAG('sugars_100g', 'sugar')}, {_FLAG('fat_100g', 'fat')}, {_FLAG('salt_100g', 'salt')},
  CAST(rank() OVER (PARTITION BY primary_category ORDER BY nutriscore_score_raw ASC NULLS LAST) AS INTEGER) AS healthiness_rank_in_category, category_product_count,
  nutriscore_grade_reported, nutriscore_grade_recalculated, nutriscore_grade_mismatch, ingest_run_id
  FROM silver JOIN benchmarks ON primary_category = bc),
fact_out AS (SELECT *, {_r("(healthiness_rank_in_category - 1.0::DOUBLE) / nullif(category_product_count - 1, 0) * 100", 1)} AS healthiness_percentile FROM fact)
"""


@query(f"WITH {FACT_SQL} SELECT * FROM fact_out")
def fact_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nutrition fact: keys, measures, category benchmarks, rank, percentile and flags."""
    return gold.fact_nutrition(silver_table(spark, sf_dir), SNAPSHOT).drop("carbohydrates_100g", "fiber_100g", "ingested_at", "silver_processed_at", "gold_built_at")


@query(f"WITH {FACT_SQL} SELECT category_name, category_avg_kcal_100g, category_avg_sugar_100g, category_avg_fat_100g, category_avg_salt_100g, category_avg_protein_100g, category_product_count FROM fact_out GROUP BY ALL")
def category_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of plausible measures by category, as partial sums."""
    return gold.category_benchmarks(silver_feed(spark, sf_dir).withColumn("category_name", rules.labelled(F.col("primary_category"))))


@query("""
SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS category_rank, count(*) OVER (PARTITION BY p_type) AS n_in_category,
  CAST(round(CAST((rank() OVER w - 1) AS DOUBLE) / nullif(count(*) OVER (PARTITION BY p_type) - 1, 0) * 100, 1) AS DOUBLE) AS percentile
FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size ASC NULLS LAST)
""")
def category_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, group size and percentile of any measure, without a window over a group."""
    rows = ranks.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "p_type", "p_size")
    return rows.select("p_partkey", F.col("rank").cast("int").alias("category_rank"), F.col("n_in_group").alias("n_in_category"), "percentile")


@query("""
SELECT sale_id, line_no, item_id, amount, rank() OVER w AS rank, count(*) OVER (PARTITION BY vendor_id) AS n_in_group,
  CAST(round(CAST((rank() OVER w - 1) AS DOUBLE) / nullif(count(*) OVER (PARTITION BY vendor_id) - 1, 0) * 100, 1) AS DOUBLE) AS percentile
FROM sale_lines WINDOW w AS (PARTITION BY vendor_id ORDER BY amount ASC NULLS LAST)
""")
def vendor_line_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale line's rank by amount among its vendor's: many different values, very unequal groups."""
    rows = ranks.ranked(table(spark, sf_dir, "sale_lines").select("sale_id", "line_no", "item_id", "vendor_id", "amount"), "vendor_id", "amount")
    return rows.drop("vendor_id")


@query(f"WITH {SILVER_SQL} SELECT DISTINCT sha256(primary_brand) AS brand_key, primary_brand AS brand_name FROM silver")
def dim_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand."""
    return gold.dim_brand(silver_feed(spark, sf_dir)).drop("gold_built_at")


@query(f"WITH {SILVER_SQL} SELECT DISTINCT sha256(primary_category) AS category_key, primary_category AS category_name FROM silver")
def dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per category."""
    return gold.dim_category(silver_feed(spark, sf_dir)).drop("gold_built_at")


@query(f"WITH {SILVER_SQL} SELECT sha256(country_iso_code) AS country_key, country_iso_code, max(primary_country) AS country_name FROM silver GROUP BY country_iso_code")
def dim_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ISO code."""
    return gold.dim_country(silver_feed(spark, sf_dir)).drop("gold_built_at")


_GRADES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in lookups.GRADE_ROWS)
GRADE_SQL = f"grades(grade, score_min, score_max, description, color_indicator) AS (VALUES {_GRADES})"


@query(f"""WITH {SILVER_SQL}, {GRADE_SQL} SELECT sha256(g.grade) AS nutriscore_key, g.grade, CAST(score_min AS INTEGER) AS score_min, CAST(score_max AS INTEGER) AS score_max, description, color_indicator, count(barcode) AS n_products
FROM grades g LEFT JOIN silver s ON g.grade = CASE WHEN nutriscore_grade_reported IN ('A', 'B', 'C', 'D', 'E') THEN nutriscore_grade_reported ELSE 'Unknown' END GROUP BY ALL""")
def dim_nutriscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades with their score bands, and how many products of silver report each."""
    grades = gold.dim_nutriscore(lookups.grade_lookup(spark)).drop("gold_built_at")
    reported = silver_feed(spark, sf_dir).groupBy(rules.grade_key(F.col("nutriscore_grade_reported")).alias("nutriscore_key")).agg(F.count("*").alias("n_products"))
    return grades.join(reported, "nutriscore_key", "left").fillna(0, ["n_products"])


@query(f"""WITH {SILVER_SQL} SELECT sha256(barcode) AS product_key, barcode AS product_id, product_name, ingredient_count, nova_group, {_NOVA_TITLE} AS nova_group_label, completeness_score,
data_quality_tier, is_nutritional_data_complete, nutriscore_grade_reported, nutriscore_grade_recalculated, nutriscore_grade_mismatch, sha256(primary_brand) AS brand_key,
sha256(primary_category) AS category_key, sha256(country_iso_code) AS country_key, ingest_run_id, 'Unknown' AS packaging, 'Milk, Tree Nuts' AS allergens FROM silver""")
def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product."""
    return gold.dim_product(silver_feed(spark, sf_dir)).drop("gold_built_at", "silver_processed_at")


@query(f"""WITH {FACT_SQL} SELECT product_key, brand_key, category_key, country_key, nutriscore_key, snapshot_date, energy_kcal_per_100g, brand_name, category_name,
(SELECT product_name FROM silver s WHERE s.barcode = product_id) AS product_name, country_name, CASE WHEN nutriscore_grade_reported IN ('A', 'B', 'C', 'D', 'E') THEN nutriscore_grade_reported ELSE 'Unknown' END AS grade
FROM fact_out""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact joined with all its dimensions by hash key."""
    rows = silver_table(spark, sf_dir)
    dims = (gold.dim_product(rows), gold.dim_brand(rows), gold.dim_category(rows), gold.dim_country(rows), gold.dim_nutriscore(lookups.grade_lookup(spark)))
    return gold.star(gold.fact_nutrition(rows, SNAPSHOT), *dims)


_COUNT = lambda p: f"count(*) FILTER (WHERE {p})"
_PCT = lambda p: f"CAST(round(count(*) FILTER (WHERE {p}) / CAST(count(*) AS DOUBLE) * 100, 2) AS DOUBLE)"


#: The audit's times without a zone, as both engines show them alike.
TIMES = ("run_ingested_at", "silver_completed_at", "audit_built_at")
AUDIT_SQL = f"""SELECT ingest_run_id, make_timestamp(min(last_modified_unix) * 1000000) AS run_ingested_at, make_timestamp(1700000000000000) AS silver_completed_at, count(*) AS total_products_processed,
count(DISTINCT barcode) AS unique_barcodes, count(DISTINCT primary_brand) AS unique_brands,
count(DISTINCT primary_category) AS unique_categories, count(DISTINCT primary_country) AS unique_countries, {_COUNT('nutriscore_grade_mismatch')} AS nutriscore_mismatch_count,
{_PCT('nutriscore_grade_mismatch')} AS nutriscore_mismatch_pct, {_COUNT('energy_kcal_per_100g IS NULL')} AS missing_kcal_count, {_COUNT('proteins_100g IS NULL')} AS missing_protein_count,
{_COUNT('sugars_100g IS NULL')} AS missing_sugar_count, {_PCT('energy_kcal_per_100g IS NULL')} AS missing_kcal_pct, {_PCT('NOT barcode_is_ean')} AS invalid_ean_pct,
{_COUNT('nova_group = 1')} AS nova_1_unprocessed_count, {_COUNT('nova_group = 2')} AS nova_2_culinary_count, {_COUNT('nova_group = 3')} AS nova_3_processed_count,
{_COUNT('nova_group = 4')} AS nova_4_ultra_processed_count, {', '.join(_COUNT(f"nutriscore_grade_reported = '{g}'") + f' AS grade_{g.lower()}_count' for g in 'ABCDE')},
{', '.join(_COUNT(f"sugar_tier = '{t}'") + f' AS sugar_{t.lower()}_count' for t in ('Low', 'Medium', 'High'))}, make_timestamp(1700000000000000) AS audit_built_at FROM silver GROUP BY ingest_run_id"""


@query(f"WITH {SILVER_SQL} {AUDIT_SQL}")
def audit_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every run, with all its columns."""
    return without_zones(gold.audit(silver_table(spark, sf_dir), fixed_time()), *TIMES)


@query(f"WITH {SILVER_SQL} {AUDIT_SQL}")
def audit_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit, kept up over three upserts of silver (in no order of time) by its change feed."""
    lines = revisions(spark, sf_dir)
    run = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyyMM").cast("int")
    silver_root, state_root = storage.fresh(spark, "silver"), storage.fresh(spark, "audit")
    for k in (1, 0, 2):
        upsert.upsert(refined_lines(spark, sf_dir, lines.filter(run % 3 == k)), silver_root)
        audits.refresh(spark, silver_root, state_root)
    return without_zones(audits.audit(upsert.read(spark, state_root), fixed_time()), *TIMES)


@query("""
SELECT strftime(ts, '%Y%m%d_%H') || '00' AS ingest_run_id, count(*) AS n_rows,
       count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types,
       min(value) AS min_value, max(value) AS max_value,
       CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_large,
       CAST(round(sum(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) / nullif(count(*), 0) * 100, 2) AS DOUBLE) AS pct_large
FROM events GROUP BY 1
""")
def pipeline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run row counts, distinct counts, extremes and shares of one event feed."""
    large = F.col("value") > 50
    return with_run(table(spark, sf_dir, "events")).groupBy("ingest_run_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("event_type").alias("n_types"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        gold.count_where(large).alias("n_large"),
        gold.percent_where(large).alias("pct_large"),
    )


def with_run(events: DataFrame) -> DataFrame:
    """Events with the id of their hourly run."""
    return events.withColumn("ingest_run_id", F.concat(F.date_format("ts", "yyyyMMdd_HH"), F.lit("00")))


RUN_SQL = "runs AS (SELECT *, strftime(ts, '%Y%m%d_%H') || '00' AS ingest_run_id FROM events)"


# Bronze and JSON.


@query("""SELECT strftime(ts, '%Y%m%d_%H') || '00' AS ingest_run_id, 'bronze' AS ingest_layer, event_id AS api_page_number, CAST(1 AS INTEGER) AS page_size,
CAST(NULL AS VARCHAR) AS fetched_at, '[' || props || ']' AS raw_products_json FROM events""")
def bronze_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed pages: lineage columns, alignment to the fixed schema with typed nulls, the page number back-filled."""
    pages = with_run(table(spark, sf_dir, "events")).select("ingest_run_id", F.col("event_id").cast("int").alias("page_number"), F.lit(None).cast("long").alias("api_page_number"), F.lit(1).alias("page_size"), F.concat(F.lit("["), "props", F.lit("]")).alias("products"))
    return bronze.bronze(pages).select("ingest_run_id", "ingest_layer", "api_page_number", "page_size", "fetched_at", "raw_products_json")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS again FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON to a struct and back."""
    parsed = F.from_json("props", "k string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("SELECT user_id, count(*) AS n_pages, CAST(sum(coalesce(json_array_length('[' || props || ',' || props || ']'), 0)) AS BIGINT) AS n_items FROM events GROUP BY user_id")
def json_array_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the lengths of JSON arrays by key."""
    array = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_pages"), F.sum(F.coalesce(F.json_array_length(array), F.lit(0))).cast("long").alias("n_items"))


@query("""SELECT event_id, json_extract_string(p, '$.k') AS k FROM (SELECT event_id, unnest(from_json('[' || props || ',{"k":"x"}]', '["JSON"]')) AS p FROM events)""")
def explode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array's elements as rows."""
    # Braces of the JSON text come as a parameter: those in the statement name tables.
    statement = """SELECT event_id, p.k FROM {events} LATERAL VIEW explode(from_json(concat('[', props, :more), 'array<struct<k:string>>')) t AS p"""
    return spark.sql(statement, {"more": ',{"k":"x"}]'}, events=table(spark, sf_dir, "events"))


# Keep-latest, upserts.


@query("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC,
l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key; ties by all other columns."""
    ties = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return silver.latest(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", ties)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's latest event of even ids, and of odd ids."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return tuple(silver.latest(events.filter(F.col("event_id") % 2 == k), ["user_id"], "ts", ["event_id"]) for k in (0, 1))


_HALF = lambda k: f"SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 2 = {k}) WHERE rn = 1"


@query(f"WITH old AS ({_HALF(0)}), new AS ({_HALF(1)}) SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed merge in which the new batch always wins."""
    return upsert.merged(*_halves(spark, sf_dir), ["user_id"])


@query(f"""WITH b AS (SELECT *, 0 AS is_new FROM ({_HALF(0)}) UNION ALL SELECT *, 1 FROM ({_HALF(1)}))
SELECT * EXCLUDE (is_new, rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, is_new DESC) AS rn FROM b) WHERE rn = 1""")
def upsert_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed merge in which an older revision never wins."""
    return upsert.merged_latest(*_halves(spark, sf_dir), ["user_id"], "ts")


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def backfill_equals_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded upserts of two batches into a stored table, the newer one first, give what one backfill gives (timestamps are unique per user)."""
    root = storage.fresh(spark, "incremental")
    for half in reversed(_halves(spark, sf_dir)):
        upsert.upsert(half, root, ["user_id"], revision="ts")
    return upsert.read(spark, root)


@query(f"WITH old AS ({_HALF(0)}), new AS ({_HALF(1)} AND user_id % 10 = 3) SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new")
def upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unguarded upsert of a few keys into a stored table: only the buckets that they touch are written anew."""
    root = storage.fresh(spark, "upserted")
    old, new = _halves(spark, sf_dir)
    upsert.overwrite(old, root, keys=["user_id"])
    upsert.upsert(new.filter("user_id % 10 = 3"), root, ["user_id"], guarded=False)
    return upsert.read(spark, root)


@query("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""")
def upsert_five_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines upserted in five batches, in no order of time, into a table whose buckets are split as it grows."""
    lines, root, keys = table(spark, sf_dir, "lineitem"), storage.fresh(spark, "lines"), ["l_orderkey", "l_linenumber"]
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    for k in (3, 0, 4, 1, 2):
        # Lines of one day are in one batch, so equal revisions meet before the upsert.
        batch = silver.latest(lines.filter(F.dayofyear("l_shipdate") % 5 == k), keys, "l_shipdate", ties)
        upsert.upsert(batch, root, keys, revision="l_shipdate", bucket_rows=20_000)
    return upsert.read(spark, root).select(*lines.columns)


@query(f"""WITH old AS ({_HALF(0)}), newer AS ({_HALF(1)}),
new AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.ts >= o.ts OR o.ts IS NULL THEN n.event_id ELSE o.event_id END AS event_id FROM old o FULL JOIN newer n ON o.user_id = n.user_id),
images AS (SELECT o.user_id AS o, n.user_id AS n, o.event_id AS oe, n.event_id AS ne FROM old o FULL JOIN new n ON o.user_id = n.user_id WHERE o.event_id IS DISTINCT FROM n.event_id)
SELECT n AS user_id, ne AS event_id, 'inserted' AS change FROM images WHERE o IS NULL UNION ALL SELECT o, oe, 'before' FROM images WHERE o IS NOT NULL UNION ALL SELECT n, ne, 'after' FROM images WHERE o IS NOT NULL""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guarded upsert changed in a stored table: inserted rows, and the two images of updated ones."""
    root = storage.fresh(spark, "fed")
    for half in _halves(spark, sf_dir):
        last = upsert.upsert(half, root, ["user_id"], revision="ts")
    return upsert.changes(spark, root, last - 1).select("user_id", "event_id", "change")


@query("SELECT o_orderkey, o_orderdate, o_orderstatus, strftime(o_orderdate, '%Y%m') AS ingest_run_id FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199504' AND '199506'")
def runs_by_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of some runs of a stored table with zones, upserted by halves of years. Each bucket holds all runs, so no folder is skipped here."""
    orders, root = table(spark, sf_dir, "orders"), storage.fresh(spark, "zoned")
    runs = orders.select("o_orderkey", "o_orderdate", "o_orderstatus", F.date_format("o_orderdate", "yyyyMM").alias("ingest_run_id"))
    for late in (0, 1):
        batch = runs.filter((F.month("o_orderdate") > 6).cast("int") == late)
        upsert.upsert(batch, root, ["o_orderkey"], guarded=False, bucket_rows=20_000, zones=["ingest_run_id"])
    return upsert.selected(spark, root, {"ingest_run_id": ("199504", "199506")})


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09)")
def keys_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a stored table that have given keys, from the buckets that these fall into."""
    root = storage.fresh(spark, "looked")
    upsert.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), root, keys=["o_orderkey"], bucket_rows=20_000)
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 AND l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return upsert.found(wanted, root)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS maker, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS BIGINT) ELSE p_size * 1000000000000 END AS amount FROM part""")
def columns_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts into a stored table: as it is, with a new column, which is then renamed, and with a wider one; footers aren't merged."""
    parts, root = table(spark, sf_dir, "part"), storage.fresh(spark, "evolved")
    batch = lambda k, *columns: upsert.upsert(parts.filter(F.col("p_partkey") % 3 == k).select("p_partkey", *columns), root, ["p_partkey"], guarded=False)
    size = F.col("p_size").cast("int").alias("amount")
    batch(0, size)
    batch(1, size, "p_brand")
    upsert.rename(spark, root, "p_brand", "maker")
    batch(2, (F.col("p_size") * F.lit(1000000000000)).cast("long").alias("amount"), F.col("p_brand").alias("maker"))
    return upsert.read(spark, root)


@query("SELECT event_id, event_type, NULL::DOUBLE AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 1")
def append_merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a table, the second with a column more: older rows have nulls there."""
    events, path = table(spark, sf_dir, "events").withColumn("ingest_run_id", F.date_format("ts", "yyyyMMdd")), storage.fresh(spark, "appended")
    bronze.add(events.filter("event_id % 2 = 0").select("ingest_run_id", "event_id", "event_type"), path)
    bronze.add(events.filter("event_id % 2 = 1").select("ingest_run_id", "event_id", "event_type", "value"), path)
    return bronze.read_all(spark, path).select("event_id", "event_type", "value")


# Rules.


@query(f"WITH {SILVER_SQL} SELECT barcode, last_modified_unix, countries_raw, country_iso_code, primary_country FROM named")
def country_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country codes and names of every revision, by alias, then by code."""
    rows = silver.with_country(feed(spark, sf_dir).select("barcode", "last_modified_unix", "countries_raw"), inline_lookup(spark))
    return rows.select("barcode", "last_modified_unix", "countries_raw", "country_iso_code", "primary_country")


@query(f"SELECT p_partkey, {_TITLE.format('p_type')} AS category, {_TITLE.format('p_name')} AS product_name, {_TITLE.format('p_type')} || ', ' || {_TITLE.format('p_name')} AS tags, 'Unknown' AS no_tags FROM part")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, name and tag-list rules."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        rules.category(F.concat(F.lit(" en:fr:"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")))).alias("category"),
        rules.product_name(F.concat(F.lit("  "), c("p_name"), F.lit(" "))).alias("product_name"),
        rules.tag_list(F.concat(F.lit("en:"), c("p_type"), F.lit(", fr:"), F.replace(c("p_name"), F.lit(" "), F.lit("-")))).alias("tags"),
        rules.tag_list(F.lit("  ")).alias("no_tags"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {_CAP.format("l_quantity * 2.5::DOUBLE", _r("l_quantity * 2.5::DOUBLE", 1))} AS fat,
CASE WHEN l_tax * 2000 > 0 AND l_tax * 2000 <= 100 THEN l_tax * 2000 END AS clamped FROM lineitem""")
def nutrient_round_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible values become null, others are rounded."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.nutrient(F.col("l_quantity") * F.lit(2.5)).alias("fat"), rules.within(F.col("l_tax") * 2000, 0.0, 100.0, open_low=True).alias("clamped"))


@query(f"WITH {SILVER_SQL} SELECT barcode, last_modified_unix, kcal, energy_kcal_per_100g FROM limited")
def energy_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kcal from kcal, kJ or mislabelled kJ."""
    return feed(spark, sf_dir).select("barcode", "last_modified_unix", "kcal", rules.energy_kcal(F.col("kcal"), F.col("kj")).alias("energy_kcal_per_100g"))


@query(f"WITH {SILVER_SQL} SELECT barcode, last_modified_unix, salt_100g, sodium_corrected_100g FROM derived")
def sodium_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sodium, from salt where there is none."""
    salt = rules.nutrient(F.col("salt"), 2)
    return feed(spark, sf_dir).select("barcode", "last_modified_unix", salt.alias("salt_100g"), rules.sodium(F.lit(None).cast("double"), salt).alias("sodium_corrected_100g"))


@query(f"WITH {SILVER_SQL} SELECT barcode, last_modified_unix, sugar_tier, fat_tier, salt_tier, protein_density_score, nova_group_label, ingredient_count FROM derived")
def tiers_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers, protein density, NOVA label and ingredient count of every revision."""
    rows = silver.enriched(silver.with_country(silver.cleansed(raw_silver(spark, sf_dir)), inline_lookup(spark)))
    return rows.select("barcode", "last_modified_unix", "sugar_tier", "fat_tier", "salt_tier", "protein_density_score", "nova_group_label", "ingredient_count")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'Not Applicable' ELSE 'Unknown' END AS reported,
CASE WHEN l_linenumber - 3 <= -1 THEN 'A' WHEN l_linenumber - 3 <= 2 THEN 'B' WHEN l_linenumber - 3 <= 10 THEN 'C' END AS recalculated,
l_returnflag = 'A' AND l_linenumber - 3 > -1 AS mismatch FROM lineitem""")
def grade_recalc_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported against recalculated grades."""
    flag = F.col("l_returnflag")
    reported = rules.reported_grade(F.when(flag == "A", " a ").when(flag == "N", "N/A").otherwise("unknown"))
    again = rules.recalculated_grade(F.col("l_linenumber") - 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reported.alias("reported"), again.alias("recalculated"), rules.grade_mismatch(reported, again).alias("mismatch"))


@query("SELECT c_custkey, regexp_matches(trim(lpad(CAST(c_custkey AS VARCHAR), CAST(4 + c_custkey % 12 AS INTEGER), '0')), '^[0-9]{8,14}$') AS is_ean FROM customer")
def barcode_ean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of 8 to 14 digits."""
    padded = F.lpad(F.col("c_custkey").cast("string"), (4 + F.col("c_custkey") % 12).cast("int"), F.lit("0"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.is_ean(padded).alias("is_ean"))


@query("""SELECT c_custkey, CAST((c_mktsegment <> 'BUILDING')::INT + 1 + (c_acctbal > 0)::INT + 0 AS INTEGER) AS completeness, CASE WHEN (c_mktsegment <> 'BUILDING')::INT + 1 + (c_acctbal > 0)::INT >= 3
THEN 'Complete' ELSE 'Sparse' END AS tier, CAST(2 + (c_acctbal > 0)::INT AS INTEGER) AS n_known, true AS any_known FROM customer""")
def completeness_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that say something, counted; nulls, blanks and labels for unknown don't."""
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "Unknown thing").otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    score = rules.completeness([segment, F.col("c_name"), balance, F.lit(" n/a ")])
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("completeness"), F.when(score >= 3, "Complete").otherwise("Sparse").alias("tier"), rules.known_count([segment, F.col("c_name"), balance]).alias("n_known"), rules.any_known([F.col("c_custkey"), balance]).alias("any_known"))


@query("SELECT p_partkey, sha256(p_partkey || '|' || p_name) AS row_hash, sha256(p_brand) AS brand_key, sha256(CASE WHEN p_size > 25 THEN p_type ELSE 'Unknown' END) AS category_key FROM part")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row hashes that skip nulls, and keys of labels with a stand-in for missing ones."""
    kind = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("  ")
    return table(spark, sf_dir, "part").select("p_partkey", rules.row_hash(F.col("p_partkey"), F.lit(None), F.col("p_name")).alias("row_hash"), rules.label_key(F.col("p_brand")).alias("brand_key"), rules.label_key(kind).alias("category_key"))


# Gates.


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders) WHERE s IS NULL")
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return quality_gates.not_null(rows, "status").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gates.unique(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')")
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gates.accepted_values(table(spark, sf_dir, "customer"), "c_mktsegment", ("BUILDING", "AUTOMOBILE", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return quality_gates.relationships(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parent, "c_custkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000")
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gates.in_range(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 0, 9000)


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_discount > 0.05) / CAST(count(*) AS DOUBLE) AS share FROM lineitem HAVING count(*) FILTER (WHERE l_discount > 0.05) / CAST(count(*) AS DOUBLE) > 0.05")
def dq_ratio_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gates.share_at_most(table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, 0.05)


# Profiles.


@query(f"WITH {RUN_SQL} SELECT event_id, ingest_run_id FROM runs JOIN (SELECT max(ingest_run_id) AS last_run FROM runs) ON ingest_run_id = last_run")
def latest_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last run, joined with a table of one row."""
    return profiling.latest_run(with_run(table(spark, sf_dir, "events"))).select("event_id", "ingest_run_id")


@query(f"WITH {RUN_SQL} SELECT ingest_run_id, count(*) AS n_rows FROM runs WHERE ingest_run_id = (SELECT ingest_run_id FROM runs ORDER BY ts DESC, event_id DESC LIMIT 1) GROUP BY 1")
def latest_run_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a scalar subquery."""
    runs = with_run(table(spark, sf_dir, "events"))
    return spark.sql("SELECT ingest_run_id, count(*) AS n_rows FROM {runs} WHERE ingest_run_id = (SELECT ingest_run_id FROM {runs} ORDER BY ts DESC, event_id DESC LIMIT 1) GROUP BY 1", runs=runs)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def having_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several values."""
    return profiling.ambiguous(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT * FROM (SELECT count(*) AS n_orders FROM orders), (SELECT count(*) AS n_lines FROM lineitem)")
def cross_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two single rows side by side."""
    orders, lines = (table(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("orders", "n_orders"), ("lineitem", "n_lines")))
    return orders.crossJoin(lines)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def group_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by the places of columns."""
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM {lines} GROUP BY 1, 2", lines=table(spark, sf_dir, "lineitem"))


@query("SELECT p_brand, p_size, count(*) AS n_rows FROM part GROUP BY 1, 2 ORDER BY n_rows DESC, p_brand, p_size LIMIT 10")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent pairs."""
    return profiling.top(table(spark, sf_dir, "part"), ["p_brand", "p_size"], 10)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount > l_tax AND (l_quantity > 49 OR l_extendedprice > 90000) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty most extreme rows of those that compare oddly."""
    odd = (F.col("l_discount") > F.col("l_tax")) & ((F.col("l_quantity") > 49) | (F.col("l_extendedprice") > 90000))
    return table(spark, sf_dir, "lineitem").filter(odd).select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(30)


@query(f"WITH {SILVER_SQL} SELECT count(*) AS total_rows, count(DISTINCT barcode) AS distinct_keys, {_COUNT('energy_kcal_per_100g IS NULL')} AS null_kcal, {_COUNT('sugars_100g < 0')} AS negative_sugars, {_COUNT('sugars_100g > fat_100g')} AS sugar_above_fat, {_COUNT('nutriscore_grade_mismatch')} AS mismatch_rows FROM silver")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    c = F.col
    checks = {"null_kcal": c("energy_kcal_per_100g").isNull(), "negative_sugars": c("sugars_100g") < 0, "sugar_above_fat": c("sugars_100g") > c("fat_100g"), "mismatch_rows": c("nutriscore_grade_mismatch")}
    return profiling.scorecard(silver_feed(spark, sf_dir), checks, "barcode")


@query(f"""WITH {SILVER_SQL} SELECT unnest(['energy_kcal_per_100g', 'sugars_100g', 'fat_100g']) AS column_name, n AS n_rows, unnest([k, s, f]) AS n_missing, CAST(round(100 * unnest([k, s, f]) / CAST(n AS DOUBLE), 2) AS DOUBLE) AS missing_pct
FROM (SELECT count(*) AS n, {_COUNT('energy_kcal_per_100g IS NULL')} AS k, {_COUNT('sugars_100g IS NULL')} AS s, {_COUNT('fat_100g IS NULL')} AS f FROM silver)""")
def missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values by column."""
    return profiling.missing(silver_feed(spark, sf_dir), ["energy_kcal_per_100g", "sugars_100g", "fat_100g"])


@query(f"WITH {SILVER_SQL} SELECT nutriscore_grade_recalculated, count(*) AS n_rows FROM silver GROUP BY 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by grade."""
    return profiling.distribution(silver_feed(spark, sf_dir), "nutriscore_grade_recalculated")


@query(f"WITH {SILVER_SQL} SELECT floor(energy_kcal_per_100g / 100) * 100 AS bin, count(*) AS n_rows FROM silver WHERE energy_kcal_per_100g BETWEEN 0 AND 900 GROUP BY 1")
def energy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by kcal, in bins of 100."""
    return profiling.histogram(silver_feed(spark, sf_dir), "energy_kcal_per_100g", 100.0, 0.0, 900.0)


@query(f"WITH {RUN_SQL} SELECT ingest_run_id, count(*) AS page_rows, CAST(sum(event_id) AS BIGINT) AS id_sum, min(ts) AS first_at, max(ts) AS last_at FROM runs GROUP BY 1")
def run_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, a sum and the time span of each run."""
    return with_run(table(spark, sf_dir, "events")).groupBy("ingest_run_id").agg(F.count("*").alias("page_rows"), F.sum("event_id").alias("id_sum"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


# Projections.


@query("SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def star_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but some."""
    return schemas.without(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query("SELECT CAST(r_name AS VARCHAR) AS alias, CAST(NULL AS VARCHAR) AS iso_code, CAST(r_regionkey AS VARCHAR) AS display_name FROM region")
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the columns, order and types of a schema; what is missing is a typed null."""
    return schemas.aligned(table(spark, sf_dir, "region"), schemas.LOOKUP, alias=F.col("r_name"), display_name=F.col("r_regionkey"))


@query("SELECT doc_id, left(text, 40) AS text_start FROM documents")
def left_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first characters of a text: a display of the whole table."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(40)).alias("text_start"))


#: The columns that gold reads of silver, in their order.
VIEW_COLUMNS = (
    "barcode product_name primary_brand primary_category primary_country country_iso_code brands_raw categories_raw countries_raw packaging allergens energy_kcal_per_100g "
    "proteins_100g fat_100g carbohydrates_100g sugars_100g salt_100g sodium_corrected_100g fiber_100g protein_density_score ingredient_count nova_group nova_group_label "
    "completeness_score data_quality_tier is_nutritional_data_complete sugar_tier fat_tier salt_tier nutriscore_score_raw nutriscore_grade_reported "
    "nutriscore_grade_recalculated nutriscore_grade_mismatch ingest_run_id ingested_at silver_processed_at last_modified_unix row_hash"
).split()
@query(f"WITH {SILVER_SQL} SELECT {_filled(VIEW_COLUMNS)} FROM silver WHERE barcode IS NOT NULL")
def silver_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gold reads of silver, by name; times without a zone, as both engines show them alike."""
    rows = spark.sql(f"SELECT {', '.join(VIEW_COLUMNS)} FROM {{silver}} WHERE barcode IS NOT NULL", silver=silver_feed(spark, sf_dir))
    return without_zones(rows, "ingested_at", "silver_processed_at")


@query("""SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS barcode, p_name AS product_name, p_brand AS brands_raw, 'en:' || lower(p_type) AS categories_raw,
l_extendedprice / 100e0 AS energy_kcal_raw_100g, l_discount * 100e0 AS sugars_100g, CAST(NULL AS DOUBLE) AS fat_100g, CAST(p_size AS INTEGER) AS nutriscore_score_raw,
CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber AS INTEGER) END AS nova_group, l_returnflag AS nutriscore_grade_reported, CAST(epoch(l_shipdate) AS BIGINT) AS last_modified_unix,
strftime(l_shipdate, '%Y%m') AS ingest_run_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7""")
def flatten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a JSON array of products, as bronze holds them, parsed by the products' schema and flattened; a product without code goes."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    product = F.struct(
        F.when(c("l_linenumber") != 7, F.lpad(c("l_partkey").cast("string"), 8, "0")).alias("code"),
        c("p_name").alias("product_name"),
        c("p_brand").alias("brands"),
        F.concat(F.lit("en:"), F.lower("p_type")).alias("categories"),
        (c("l_extendedprice") / F.lit(100.0)).alias("energy-kcal_100g"),
        (c("l_discount") * F.lit(100.0)).cast("string").alias("sugars_100g"),
        F.lit("none").alias("fat_100g"),
        c("p_size").alias("nutriscore_score"),
        F.when(c("l_linenumber") == 5, "unknown").otherwise(F.concat(c("l_linenumber").cast("string"), F.lit(".0"))).alias("nova_group"),
        c("l_returnflag").alias("nutriscore_grade"),
        F.unix_timestamp(c("l_shipdate").cast("timestamp")).alias("last_modified_t"),
        F.struct(F.lit(1).alias("deep")).alias("images"),
    )
    # A page is a month's lines of one order: a handful, so lines are dealt out before anything is collected; collecting on both sides of the
    # shuffle would sort them twice and save nothing.
    run = F.date_format(c("l_shipdate").cast("timestamp"), "yyyyMM")
    dealt = lines.select("l_orderkey", run.alias("ingest_run_id"), product.alias("product")).repartition("l_orderkey", "ingest_run_id")
    pages = dealt.groupBy("l_orderkey", "ingest_run_id").agg(F.to_json(F.collect_list("product")).alias("raw_products_json")).withColumn("ingested_at", fixed_time())
    out = "barcode product_name brands_raw categories_raw energy_kcal_raw_100g sugars_100g fat_100g nutriscore_score_raw nova_group nutriscore_grade_reported last_modified_unix ingest_run_id"
    return silver.flat(silver.products(pages)).select(*out.split())


_GOLD_COUNTS = {
    "dim_product": "SELECT count(*) FROM silver", "dim_brand": "SELECT count(DISTINCT primary_brand) FROM silver", "dim_category": "SELECT count(DISTINCT primary_category) FROM silver",
    "dim_country": "SELECT count(DISTINCT country_iso_code) FROM silver", "dim_nutriscore": "SELECT 6", "fact_product_nutrition": "SELECT count(*) FROM silver",
    "pipeline_audit": "SELECT count(DISTINCT ingest_run_id) FROM silver",
}


@query(f"WITH {SILVER_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, ({sql}) AS n_rows" for n, sql in _GOLD_COUNTS.items()))
def gold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold table built from a stored silver, written as a versioned table and read back: their rows."""
    made = gold.materialised(silver_table(spark, sf_dir), lookups.grade_lookup(spark), storage.fresh(spark, "gold"), SNAPSHOT, fixed_time())
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in made.items()]
    return reduce(DataFrame.unionByName, counts)


#: Of each gold table what its rows are told by in SQL, and the columns that say the same.
_GOLD_ROWS = {
    "dim_product": ("SELECT sha256(barcode) AS key, product_name || '|' || ingest_run_id AS content FROM silver", ("product_name", "ingest_run_id")),
    "dim_brand": ("SELECT DISTINCT sha256(primary_brand), primary_brand FROM silver", ("brand_name",)),
    "dim_category": ("SELECT DISTINCT sha256(primary_category), primary_category FROM silver", ("category_name",)),
    "dim_country": ("SELECT sha256(country_iso_code), country_iso_code || '|' || max(primary_country) FROM silver GROUP BY country_iso_code", ("country_iso_code", "country_name")),
    "dim_nutriscore": ("SELECT sha256(grade), grade || '|' || description FROM grades", ("grade", "description")),
    "fact_product_nutrition": ("SELECT product_key, category_name || '|' || healthiness_rank_in_category || '|' || category_product_count || '|' || is_above_avg_sugar FROM fact_out", ("category_name", "healthiness_rank_in_category", "category_product_count", "is_above_avg_sugar")),
    "pipeline_audit": ("SELECT ingest_run_id, count(*) || '|' || count(DISTINCT primary_brand) FROM silver GROUP BY 1", ("total_products_processed", "unique_brands")),
}


@query(f"WITH {FACT_SQL}, {GRADE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({sql})" for n, (sql, _) in _GOLD_ROWS.items()))
def gold_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every gold table, written and read back: key and what tells most about a row."""
    made = gold.materialised(silver_table(spark, sf_dir), lookups.grade_lookup(spark), storage.fresh(spark, "gold"), SNAPSHOT, fixed_time())
    rows = [df.select(F.lit(n).alias("table_name"), F.col(gold.TABLES[n]).alias("key"), F.concat_ws("|", *[F.col(c).cast("string") for c in _GOLD_ROWS[n][1]]).alias("content")) for n, df in made.items()]
    return reduce(DataFrame.unionByName, rows)


@query(f"""WITH {SILVER_SQL}, last AS (SELECT * FROM silver WHERE ingest_run_id = (SELECT max(ingest_run_id) FROM silver))
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT barcode) AS n FROM silver GROUP BY ingest_run_id)) AS unique_products, count(*) AS products_latest_run, {_PCT('nutriscore_grade_mismatch')} AS mismatch_pct,
{_PCT('energy_kcal_per_100g IS NULL')} AS missing_kcal_pct, CAST(1.5 AS DOUBLE) AS hours_since FROM last""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run's numbers and its age, from the audit."""
    return profiling.run_health(gold.audit(silver_table(spark, sf_dir)), F.timestamp_seconds(F.lit(1700000000 + 5400))).drop("completed_at")


@query(f"WITH {RUN_SQL} SELECT event_type, count(*) AS n_rows FROM runs WHERE ingest_run_id = (SELECT min(ingest_run_id) FROM runs) GROUP BY 1")
def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on one run of all."""
    runs = with_run(table(spark, sf_dir, "events"))
    return profiling.distribution(profiling.of_run(runs, runs.agg(F.min("ingest_run_id")).first()[0]), "event_type")


@query(f"WITH {SILVER_SQL} SELECT barcode, product_name, primary_category, ingest_run_id FROM silver WHERE energy_kcal_per_100g IS NULL ORDER BY barcode LIMIT 20")
def null_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty products without calories, to be looked into."""
    return profiling.samples(silver_feed(spark, sf_dir), F.col("energy_kcal_per_100g").isNull(), ["barcode", "product_name", "primary_category", "ingest_run_id"], 20)


@query("SELECT count(*) AS n_rows FROM (SELECT * FROM events LIMIT 25)")
def limit_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows, whichever come first: how many there are."""
    return table(spark, sf_dir, "events").limit(25).agg(F.count("*").alias("n_rows"))


@query("""SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS col_name, unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS data_type, unnest([a, b, c, d, e, f]) AS n_known
FROM (SELECT count(event_id) AS a, count(ts) AS b, count(user_id) AS c, count(event_type) AS d, count(value) AS e, count(props) AS f FROM events)""")
def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of a table's columns, with the rows that have a value."""
    return profiling.described(table(spark, sf_dir, "events"))


@query(f"WITH {SILVER_SQL} SELECT {', '.join(profiling.RUN_COLUMNS)} FROM ({AUDIT_SQL})")
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs with their volume and quality."""
    return without_zones(profiling.run_table(gold.audit(silver_table(spark, sf_dir), fixed_time())), "run_ingested_at", "silver_completed_at")


_LINE = lambda m: f"SELECT '{m}' AS measure, ingest_run_id, CAST({m} AS DOUBLE) AS value, lag(CAST({m} AS DOUBLE)) OVER (ORDER BY ingest_run_id) AS previous FROM a"


@query(f"""WITH {SILVER_SQL}, a AS ({AUDIT_SQL}), lines AS ({' UNION ALL '.join(map(_LINE, profiling.TRENDS))})
SELECT measure, ingest_run_id, value, previous, CAST(round(value - previous, 2) AS DOUBLE) AS change, coalesce(value < 0.5 * previous, false) AS dropped FROM lines""")
def run_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, missing calories and grade mismatches over runs."""
    return profiling.run_trends(gold.audit(silver_table(spark, sf_dir), fixed_time()))


@query(f"""WITH {FACT_SQL} SELECT 'fact.sweet' AS gate, {_COUNT('sugars_100g > 50')} AS n_rows FROM fact_out UNION ALL SELECT 'fact.no energy', {_COUNT('energy_kcal_per_100g IS NULL')} FROM fact_out UNION ALL SELECT 'fact.no key', 0""")
def gates_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that are counted by the pass that writes a table."""
    c = F.col
    gates = {"fact.sweet": c("sugars_100g") > 50, "fact.no energy": c("energy_kcal_per_100g").isNull(), "fact.no key": c("product_key").isNull()}
    fact, found = quality_gates.observed(gold.fact_nutrition(silver_table(spark, sf_dir), SNAPSHOT, fixed_time()), gates)
    upsert.overwrite(fact, storage.fresh(spark, "gated"), keys=["product_key"])
    return spark.createDataFrame(list(found().items()), "gate string, n_rows long")


#: How customers' countries are written, by customer key: name, expected code and name.
_WRITTEN = [("en:france", "FR", "France"), ("Deutschland, France", "DE", "Germany"), ("zz", "ZZ", "Unknown Country"), ("U.S.A.", "US", "United States"), ("Nowhere Land", "XX", "Unknown Country"), ("en:viet-nam", "VN", "Vietnam"), ("CHE", "CH", "Switzerland"), ("Lalaland", "LA", "Our Laos")]


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code, _) in enumerate(_WRITTEN)) + " END AS country_iso_code, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, _, name) in enumerate(_WRITTEN)) + " END AS primary_country FROM customer")
def country_by_generated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by the generated aliases, written to a CSV with an extra one and read back as the lookup."""
    countries = lookups.iso_countries(spark)
    rows = lookups.alias_rows(countries, [*lookups.exonyms(spark, countries), ("lalaland", "la", "Our Laos")])
    path = storage.fresh(spark, "aliases")
    spark.createDataFrame(rows, schemas.LOOKUP).write.option("header", True).csv(path)
    written = F.element_at(F.array(*[F.lit(w) for w, _, _ in _WRITTEN]), (F.col("c_custkey") % 8 + 1).cast("int"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", written.alias("countries_raw"))
    return silver.with_country(customers, lookups.country_lookup(spark, path)).select("c_custkey", "country_iso_code", "primary_country")


# Pages: landed, and read by the page source.

PAGE_ROWS = 1000
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def landed_events(spark: SparkSession, sf_dir: str) -> str:
    """Events landed as the pages of a source, in the order of their ids, with their number beside them."""
    folder, events = storage.fresh(spark, "landed"), table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value", "props"))
    page = (F.floor(F.col("event_id") / PAGE_ROWS) + 1).cast("int").alias("page")
    events.select(body.alias("value"), page).hint("rebalance", "page").write.partitionBy("page").text(folder)
    events.agg(F.count("*").cast("string").alias("value")).write.text(f"{folder}/count")
    return folder


def _source(folder: str) -> dict[str, str]:
    return {"url": folder, "transport": "larder.sources.page_source:mounted", "run_id": "20240101_0000", "records_per_page": str(PAGE_ROWS)}


PAGED_SQL = f"""SELECT '20240101_0000' AS ingest_run_id, CAST(event_id // {PAGE_ROWS} + 1 AS BIGINT) AS api_page_number,
CAST(count(*) OVER (PARTITION BY event_id // {PAGE_ROWS}) AS INTEGER) AS page_size, count(*) OVER () AS total_products_reported, event_id, ts, user_id, event_type, value, props FROM events"""


def _paged_events(pages: DataFrame) -> DataFrame:
    rows = bronze.bronze(pages)
    return rows.select("ingest_run_id", "api_page_number", "page_size", "total_products_reported", F.inline(F.from_json("raw_products_json", f"array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>")))


@query(PAGED_SQL)
def pages_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages read by the page source, a partition each, one page too many asked for; through bronze to rows."""
    ship(spark)
    page_source.register(spark)
    folder = landed_events(spark, sf_dir)
    pages = -(-table(spark, sf_dir, "events").count() // PAGE_ROWS) + 1
    return _paged_events(spark.read.format(page_source.FORMAT).options(**_source(folder), pages=str(pages)).load())


@query(PAGED_SQL)
def pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream whose offset is the page window, upserted by event; started again, it finds nothing new."""
    ship(spark)
    page_source.register(spark)
    folder, root, checkpoint = landed_events(spark, sf_dir), storage.fresh(spark, "paged"), storage.fresh(spark, "offsets")

    def batch(rows: DataFrame, _: int) -> None:
        upsert.upsert(_paged_events(rows), root, ["event_id"], guarded=False)

    for _ in range(2):
        stream = spark.readStream.format(page_source.FORMAT).options(**_source(folder)).load()
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return upsert.read(spark, root)


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event by a stream with keyed state, in two batches of files of which the first holds the later half."""
    ship(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    folder, root, checkpoint = storage.fresh(spark, "arrived"), storage.fresh(spark, "latest"), storage.fresh(spark, "state")
    # A state partition for every hundred thousand keys, by the number of rows.
    partitions = 4 + events.count() // 100_000
    for odd in (1, 0):
        events.filter(F.col("event_id") % 2 == odd).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        latest_stream.keep_latest(stream, ["user_id"], "ts", root, checkpoint, ["event_id"], late="400 days", partitions=partitions).awaitTermination()
    return without_zones(upsert.read(spark, root), "ts")


# Distinct counts and variants.


@query("""WITH r AS (SELECT strftime(sold_at, '%Y%m%d') AS run, CAST(client_id AS VARCHAR) AS client, status FROM sales)
SELECT substr(run, 1, 6) AS runs, count(DISTINCT client) AS unique_clients, count(DISTINCT status) AS unique_states FROM r GROUP BY 1
UNION ALL SELECT 'weekday ' || CAST(dayofweek(strptime(run, '%Y%m%d')) + 1 AS VARCHAR), count(DISTINCT client), count(DISTINCT status) FROM r GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT client), count(DISTINCT status) FROM r""")
def distinct_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct clients and states of the daily runs, by month, by weekday and of all: from bitmaps stored once."""
    daily = table(spark, sf_dir, "sales").select(F.date_format("sold_at", "yyyyMMdd").alias("run"), "client_id", "status")
    bitmaps = distinct.run_bitmaps(daily, {"client_id": "clients", "status": "states"}, "run")
    day = F.to_date("run", "yyyyMMdd")
    sets = (F.substring("run", 1, 6), F.concat(F.lit("weekday "), F.dayofweek(day).cast("string")), F.lit("all"))
    return reduce(DataFrame.unionByName, [distinct.counted(bitmaps, ["clients", "states"], by).withColumnRenamed("k0", "runs") for by in sets])


_PROPS = "CASE WHEN json_valid(props) THEN props END"


@query(f"""SELECT click_id, TRY_CAST(json_extract_string(p, '$.k') AS INTEGER) AS k, json_extract_string(p, '$.device.os') AS os, json_extract_string(p, '$.tags[0]') AS first_tag,
CAST(NULL AS VARCHAR) AS broken FROM (SELECT click_id, {_PROPS} AS p, props FROM clicks) WHERE props IS NULL OR p IS NOT NULL
UNION ALL SELECT click_id, NULL, NULL, NULL, props FROM clicks WHERE NOT json_valid(props)""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of semi-structured JSON by their paths, and the rows whose text is broken, which go to quarantine."""
    good, broken = variants.split(table(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    found = variants.fields(good, {"k": ("$.k", "int"), "os": ("$.device.os", "string"), "first_tag": ("$.tags[0]", "string")})
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return found.select("click_id", "k", "os", "first_tag", none("broken", "string")).unionByName(broken.select("click_id", none("k", "int"), none("os", "string"), none("first_tag", "string"), F.col("props").alias("broken")))


@query(f"""SELECT click_id, CAST(i - 1 AS INTEGER) AS position, TRY_CAST(json_extract_string(e, '$.sku') AS BIGINT) AS sku, TRY_CAST(json_extract_string(e, '$.qty') AS INTEGER) AS qty
FROM (SELECT click_id, unnest(items) AS e, generate_subscripts(items, 1) AS i FROM (SELECT click_id, from_json(json_extract({_PROPS}, '$.items'), '["JSON"]') AS items FROM clicks))""")
def variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of an array inside semi-structured JSON, with their places."""
    rows = variants.elements(variants.parsed(table(spark, sf_dir, "clicks").select("click_id", "props"), "props"), "$.items", "click_id")
    return rows.select("click_id", F.col("position").cast("int").alias("position"), F.try_variant_get("element", "$.sku", "long").alias("sku"), F.try_variant_get("element", "$.qty", "int").alias("qty"))


@query(f"""SELECT key, count(*) AS n_rows FROM (SELECT unnest(json_keys({_PROPS})) AS key FROM clicks) GROUP BY 1""")
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key occurs."""
    found = variants.members(variants.parsed(table(spark, sf_dir, "clicks").select("props"), "props"))
    return found.groupBy("key").agg(F.sum("n_rows").alias("n_rows"))
