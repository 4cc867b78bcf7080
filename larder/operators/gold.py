"""Gold: dimensions, the nutrition fact with category benchmarks, and the audit of runs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import storage
from larder.functions import rules
from larder.operators import quality_gates, upsert
from larder.operators.silver import latest

#: Measure -> its column in the benchmarks and whether 0 counts as known.
BENCHMARKS = {
    "energy_kcal_per_100g": ("category_avg_kcal_100g", rules.KCAL_LIMIT, True),
    "sugars_100g": ("category_avg_sugar_100g", rules.GRAM_LIMIT, False),
    "fat_100g": ("category_avg_fat_100g", rules.GRAM_LIMIT, False),
    "salt_100g": ("category_avg_salt_100g", rules.GRAM_LIMIT, False),
    "proteins_100g": ("category_avg_protein_100g", rules.GRAM_LIMIT, False),
}


def _built(built_at: Column | None) -> Column:
    return (F.current_timestamp() if built_at is None else built_at).alias("gold_built_at")


def _label_dimension(silver: DataFrame, column: str, name: str, built_at: Column | None) -> DataFrame:
    """One row per label of a column, keyed by its hash."""
    labels = silver.select(rules.labelled(F.col(column)).alias(f"{name}_name")).distinct()
    return labels.select(F.sha2(f"{name}_name", 256).alias(f"{name}_key"), f"{name}_name", _built(built_at))


def dim_brand(silver: DataFrame, built_at: Column | None = None) -> DataFrame:
    return _label_dimension(silver, "primary_brand", "brand", built_at)


def dim_category(silver: DataFrame, built_at: Column | None = None) -> DataFrame:
    return _label_dimension(silver, "primary_category", "category", built_at)


def dim_country(silver: DataFrame, built_at: Column | None = None) -> DataFrame:
    """One row per ISO code, with the largest of its names."""
    known = silver.filter(~rules.blank(F.col("country_iso_code")) & ~rules.blank(F.col("primary_country")))
    names = known.groupBy("country_iso_code").agg(F.max("primary_country").alias("country_name"))
    return names.select(F.sha2("country_iso_code", 256).alias("country_key"), "country_iso_code", "country_name", _built(built_at))


def dim_nutriscore(lookup: DataFrame, built_at: Column | None = None) -> DataFrame:
    grade = rules.lookup_grade(F.col("grade"))
    return lookup.select(F.sha2(grade, 256).alias("nutriscore_key"), grade.alias("grade"), "score_min", "score_max", "description", "color_indicator", _built(built_at))


def _keys() -> list[Column]:
    return [
        rules.label_key(F.col("primary_brand")).alias("brand_key"),
        rules.label_key(F.col("primary_category")).alias("category_key"),
        F.sha2("country_iso_code", 256).alias("country_key"),
    ]


def dim_product(silver: DataFrame, built_at: Column | None = None) -> DataFrame:
    """The latest row of each barcode as a dimension."""
    kept = "completeness_score data_quality_tier is_nutritional_data_complete nutriscore_grade_reported nutriscore_grade_recalculated nutriscore_grade_mismatch".split()
    return latest(silver.filter("barcode IS NOT NULL")).select(
        F.sha2("barcode", 256).alias("product_key"),
        F.col("barcode").alias("product_id"),
        "product_name",
        "packaging",
        "allergens",
        "ingredient_count",
        "nova_group",
        rules.nova_title(F.col("nova_group_label")).alias("nova_group_label"),
        *kept,
        *_keys(),
        "ingest_run_id",
        "silver_processed_at",
        _built(built_at),
    )


def category_benchmarks(rows: DataFrame, category: str = "category_name") -> DataFrame:
    """Average of each measure's plausible values and the number of products, by category.

    An aggregation with partial sums: a category that holds a third of all products is no larger
    a task than another, which windows over the rows would make it.
    """
    averages = [rules.rounded(F.avg(rules.within(F.col(m), 0.0, limit, open_low)), 1, exact=10).alias(name) for m, (name, limit, open_low) in BENCHMARKS.items()]
    return rows.groupBy(category).agg(*averages, F.count("*").alias("category_product_count"))


def category_ranks(rows: DataFrame, category: str = "category_name", score: str = "nutriscore_score_raw") -> DataFrame:
    """Rank of each score in its category, equal scores alike, missing scores last: from counts per score.

    There are few scores, so the running sum goes over (category, score) rows, not over products.
    """
    counts = rows.groupBy(category, score).agg(F.count("*").alias("n"))
    before = Window.partitionBy(category).orderBy(F.col(score).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(category).alias("rank_category"), F.col(score).alias("rank_score"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("int").alias("healthiness_rank_in_category"))


#: Rows of a stored side table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, name: str) -> DataFrame:
    """df stored, and marked for a broadcast if it has few rows."""
    kept = storage.stored(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def fact_nutrition(silver: DataFrame, snapshot: str | datetime.date | None = None, built_at: Column | None = None) -> DataFrame:
    """One row per product and snapshot day: keys, measures, category benchmarks, rank and flags."""
    c = F.col
    day = F.current_date() if snapshot in (None, "") else F.lit(str(snapshot)).cast("date")
    rows = silver.withColumns({"category_name": rules.labelled(c("primary_category")), "brand_name": rules.labelled(c("primary_brand"))})
    # Stored, so that both sides of each join are plain exchanges and Spark splits a hot category; broadcast while a count says they are small.
    benchmarks = _small(category_benchmarks(rows).withColumnRenamed("category_name", "benchmark_category"), "benchmarks")
    ranks = _small(category_ranks(rows), "ranks")
    joined = rows.join(benchmarks, c("category_name") == c("benchmark_category")).join(
        ranks, (c("category_name") == c("rank_category")) & c("nutriscore_score_raw").eqNullSafe(c("rank_score"))
    )
    one, two = (lambda n: F.round(n, 1).alias(n)), (lambda n: F.round(n, 2).alias(n))
    others = F.nullif(c("category_product_count") - 1, F.lit(0))
    return joined.select(
        F.sha2("barcode", 256).alias("product_key"),
        *_keys(),
        rules.grade_key(c("nutriscore_grade_reported")).alias("nutriscore_key"),
        day.alias("snapshot_date"),
        c("barcode").alias("product_id"),
        "brand_name",
        "category_name",
        c("primary_country").alias("country_name"),
        "country_iso_code",
        "data_quality_tier",
        "completeness_score",
        "is_nutritional_data_complete",
        *[one(n) for n in ("energy_kcal_per_100g", "proteins_100g", "fat_100g", "carbohydrates_100g", "sugars_100g")],
        *[two(n) for n in ("salt_100g", "sodium_corrected_100g")],
        *[one(n) for n in ("fiber_100g", "protein_density_score")],
        "nutriscore_score_raw",
        "ingredient_count",
        "nova_group",
        rules.nova_title(c("nova_group_label")).alias("nova_group_label"),
        "sugar_tier",
        "fat_tier",
        "salt_tier",
        rules.protein_tier(c("protein_density_score")).alias("protein_density_tier"),
        *[name for name, _, _ in BENCHMARKS.values()],
        *[rules.above(c(m), c(BENCHMARKS[m][0])).alias(f"is_above_avg_{n}") for m, n in (("sugars_100g", "sugar"), ("fat_100g", "fat"), ("salt_100g", "salt"))],
        "healthiness_rank_in_category",
        "category_product_count",
        rules.rounded((c("healthiness_rank_in_category") - 1) / others * 100, 1).alias("healthiness_percentile"),
        "nutriscore_grade_reported",
        "nutriscore_grade_recalculated",
        "nutriscore_grade_mismatch",
        "ingest_run_id",
        "ingested_at",
        "silver_processed_at",
        _built(built_at),
    )


def count_where(p: Column) -> Column:
    return F.count_if(F.coalesce(p, F.lit(False)))


def percent_where(p: Column) -> Column:
    """Share of rows in percent, two decimals; null without rows."""
    return F.round(count_where(p) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2)


#: Columns whose values the audit counts -> what they are called there.
DISTINCT = {"barcode": "barcodes", "primary_brand": "brands", "primary_category": "categories", "primary_country": "countries"}


def distinct_values(silver: DataFrame) -> DataFrame:
    """How many values of each column a run has: from one narrow row for each (run, column, value), combined on the map side."""
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for c, n in DISTINCT.items()])
    pairs = silver.select("ingest_run_id", F.inline(values)).filter("value IS NOT NULL").distinct()
    return pairs.groupBy("ingest_run_id").agg(*[F.count_if(F.col("name") == n).alias(f"unique_{n}") for n in DISTINCT.values()])


def audited() -> dict[str, Column]:
    """The conditions of which the audit counts the rows."""
    c = F.col
    nova = {1: "unprocessed", 2: "culinary", 3: "processed", 4: "ultra_processed"}
    return {
        "nutriscore_mismatch": c("nutriscore_grade_mismatch"),
        "missing_kcal": c("energy_kcal_per_100g").isNull(),
        "missing_protein": c("proteins_100g").isNull(),
        "missing_sugar": c("sugars_100g").isNull(),
        "invalid_ean": ~rules.is_ean(c("barcode")),
        **{f"nova_{k}_{n}": c("nova_group") == k for k, n in nova.items()},
        **{f"grade_{g.lower()}": c("nutriscore_grade_reported") == g for g in rules.GRADES},
        **{f"sugar_{t.lower()}": c("sugar_tier") == t for t in ("Low", "Medium", "High")},
    }


#: Conditions of which the audit has the share in percent; of the last, it has nothing else.
SHARES = ("nutriscore_mismatch", "missing_kcal", "invalid_ean")


def audit_columns() -> list[str]:
    """The audit's columns in their order."""
    counts = [n for n in audited() if n != "invalid_ean"]
    shown = [f"{n}_count" for n in counts]
    shown.insert(1, "nutriscore_mismatch_pct")
    shown[5:5] = ["missing_kcal_pct", "invalid_ean_pct"]
    return ["ingest_run_id", "run_ingested_at", "silver_completed_at", "total_products_processed", *[f"unique_{n}" for n in DISTINCT.values()], *shown, "audit_built_at"]


def audit(silver: DataFrame, built_at: Column | None = None) -> DataFrame:
    """Volume, quality and completeness of each run's current rows, a row a run in no order."""
    conditions = audited()
    counted = silver.groupBy("ingest_run_id").agg(
        F.min("ingested_at").alias("run_ingested_at"),
        F.max("silver_processed_at").alias("silver_completed_at"),
        F.count("*").alias("total_products_processed"),
        *[count_where(p).alias(f"{n}_count") for n, p in conditions.items()],
        *[percent_where(conditions[n]).alias(f"{n}_pct") for n in SHARES],
    )
    # One row a run on both sides.
    unique = distinct_values(silver).withColumnRenamed("ingest_run_id", "run")
    both = counted.join(unique, F.col("ingest_run_id").eqNullSafe(F.col("run")), "left")
    filled = both.fillna(0, [f"unique_{n}" for n in DISTINCT.values()])
    return filled.withColumn("audit_built_at", F.current_timestamp() if built_at is None else built_at).select(*audit_columns())


#: The gold tables and the key that each is kept by.
TABLES = {"dim_product": "product_key", "dim_brand": "brand_key", "dim_category": "category_key", "dim_country": "country_key", "dim_nutriscore": "nutriscore_key", "fact_product_nutrition": "product_key", "pipeline_audit": "ingest_run_id"}


def row_gates(name: str) -> dict[str, Column]:
    """What no row of a gold table may be, by the name of the gate: gates that are counted while the table is written."""
    missing = lambda *columns: {f"{name}.{c} not null": F.col(c).isNull() for c in columns}
    outside = quality_gates.outside
    gates = {
        "dim_product": {**missing("product_key", "product_id"), "dim_product.tier accepted": quality_gates.not_among("data_quality_tier", ("Complete", "Sparse"))},
        "dim_brand": missing("brand_key", "brand_name"),
        "dim_category": missing("category_key"),
        "dim_country": missing("country_key"),
        "dim_nutriscore": {**missing("nutriscore_key", "grade"), "dim_nutriscore.grade accepted": quality_gates.not_among("grade", (*rules.GRADES, "Unknown"))},
        "fact_product_nutrition": {
            **missing("product_key", "brand_key", "category_key", "snapshot_date"),
            f"{name}.energy in range": outside("energy_kcal_per_100g", 0, rules.KCAL_LIMIT),
            **{f"{name}.{n} in range": outside(n, 0, limit) for n, limit, _ in BENCHMARKS.values()},
        },
    }
    return gates.get(name, {})


def materialised(silver: DataFrame, grades: DataFrame, root: str, snapshot: str | datetime.date | None = None, built_at: Column | None = None, violations: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Builds and writes every gold table under root from a silver table; returns them as read back.

    Each is a versioned table of its own (see upsert): readers have the version before until the new one is complete. The gates on
    single rows are counted by the pass that writes a table; violations gets what they find.
    """
    spark = silver.sparkSession
    made = {
        "dim_product": dim_product(silver, built_at),
        "dim_brand": dim_brand(silver, built_at),
        "dim_category": dim_category(silver, built_at),
        "dim_country": dim_country(silver, built_at),
        "dim_nutriscore": dim_nutriscore(grades, built_at),
        "fact_product_nutrition": fact_nutrition(silver, snapshot, built_at),
        "pipeline_audit": audit(silver, built_at),
    }
    for name, df in made.items():
        watched, found = quality_gates.observed(df, row_gates(name))
        upsert.overwrite(watched, f"{root}/{name}", keys=[TABLES[name]])
        if violations is not None:
            violations |= found()
    return {name: upsert.read(spark, f"{root}/{name}") for name in made}


def star(fact: DataFrame, product: DataFrame, brand: DataFrame, category: DataFrame, country: DataFrame, nutriscore: DataFrame) -> DataFrame:
    """The fact with its dimensions' labels, joined by their keys."""
    return (
        fact.select("product_key", "brand_key", "category_key", "country_key", "nutriscore_key", "snapshot_date", "energy_kcal_per_100g")
        .join(product.select("product_key", "product_name"), "product_key")
        .join(brand.select("brand_key", "brand_name"), "brand_key")
        .join(category.select("category_key", "category_name"), "category_key")
        .join(country.select("country_key", "country_name"), "country_key", "left")
        .join(nutriscore.select("nutriscore_key", "grade"), "nutriscore_key")
    )
