"""Silver: one cleansed, enriched row per product, the latest revision of each barcode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import rules
from larder.operators.bronze import require_rows
from larder.sources.lookups import keyed
from larder.sources.schemas import PRODUCTS

MACROS = ("proteins_100g", "fat_100g", "carbohydrates_100g", "sugars_100g", "fiber_100g")
KEY, REVISION = "barcode", "last_modified_unix"
SILVER_COLUMNS = (
    "barcode product_name brands_raw categories_raw countries_raw quantity_raw serving_size_raw energy_raw_100g energy_kcal_raw_100g proteins_100g fat_100g "
    "carbohydrates_100g sugars_100g salt_100g sodium_raw_100g fiber_100g nutriscore_score_raw nutriscore_grade_reported nova_group ingredients_text allergens "
    "packaging last_modified_unix ingest_run_id ingested_at primary_category country_iso_code primary_country primary_brand energy_kcal_per_100g barcode_is_ean "
    "sodium_corrected_100g sugar_tier fat_tier salt_tier protein_density_score nova_group_label ingredient_count nutriscore_grade_recalculated "
    "nutriscore_grade_mismatch completeness_score data_quality_tier is_nutritional_data_complete row_hash silver_processed_at"
).split()


def products(bronze: DataFrame) -> DataFrame:
    """Each page's products as rows; text that is no JSON array gives none."""
    items = bronze.select(F.explode(F.from_json("raw_products_json", PRODUCTS)).alias("p"), "ingest_run_id", "ingested_at")
    return items.filter(F.col("p").isNotNull())


def flat(items: DataFrame) -> DataFrame:
    """The products' fields as typed columns; rows without a barcode are left out at once."""
    text = lambda name: F.col(f"p.`{name}`")
    columns = {
        "barcode": text("code"),
        "product_name": text("product_name"),
        "brands_raw": text("brands"),
        "categories_raw": text("categories"),
        "countries_raw": text("countries"),
        "quantity_raw": text("quantity"),
        "serving_size_raw": text("serving_size"),
        "energy_raw_100g": rules.number(text("energy_100g")),
        "energy_kcal_raw_100g": rules.number(text("energy-kcal_100g")),
        **{n: rules.number(text(n)) for n in ("proteins_100g", "fat_100g", "carbohydrates_100g", "sugars_100g", "salt_100g")},
        "sodium_raw_100g": rules.number(text("sodium_100g")),
        "fiber_100g": rules.number(text("fiber_100g")),
        "nutriscore_score_raw": rules.whole(text("nutriscore_score")),
        "nutriscore_grade_reported": text("nutriscore_grade"),
        "nova_group": rules.whole(text("nova_group")),
        **{n: text(n) for n in ("ingredients_text", "allergens", "packaging")},
        "last_modified_unix": F.coalesce(text("last_modified_t").try_cast("long"), rules.number(text("last_modified_t")).try_cast("long")),
    }
    rows = items.select(*[c.alias(n) for n, c in columns.items()], "ingest_run_id", "ingested_at")
    return rows.filter(F.col(KEY).isNotNull())


def cleansed(rows: DataFrame) -> DataFrame:
    """Rules that need the raw columns only."""
    c = F.col
    salt = rules.nutrient(c("salt_100g"), 2)
    sodium = rules.nutrient(c("sodium_raw_100g"), 2)
    score = c("nutriscore_score_raw")
    reported = rules.reported_grade(c("nutriscore_grade_reported"))
    return rows.withColumns(
        {
            **{n: rules.nutrient(c(n)) for n in MACROS},
            "salt_100g": salt,
            "sodium_raw_100g": sodium,
            "product_name": rules.product_name(c("product_name")),
            "allergens": rules.tag_list(c("allergens")),
            "packaging": rules.tag_list(c("packaging")),
            "primary_category": rules.category(rules.first_of(c("categories_raw"))),
            "primary_brand": rules.first_of(c("brands_raw")),
            "energy_kcal_per_100g": rules.energy_kcal(c("energy_kcal_raw_100g"), c("energy_raw_100g")),
            "barcode_is_ean": rules.is_ean(c("barcode")),
            "sodium_corrected_100g": rules.sodium(sodium, salt),
            "nova_group_label": rules.nova_label(c("nova_group")),
            "ingredient_count": rules.ingredient_count(c("ingredients_text")),
            "nutriscore_grade_reported": reported,
            "nutriscore_grade_recalculated": rules.recalculated_grade(score),
            "nutriscore_grade_mismatch": rules.grade_mismatch(reported, rules.recalculated_grade(score)),
            "row_hash": rules.row_hash(c("barcode"), c("last_modified_unix")),
        }
    )


def with_country(rows: DataFrame, lookup: DataFrame, same_key: bool = True, broadcast_rows: int = 100_000) -> DataFrame:
    """country_iso_code and primary_country by two lookups; the table is broadcast while it is small."""
    by_alias, by_code = keyed(lookup, same_key)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_alias, by_code = F.broadcast(by_alias), F.broadcast(by_code)
    key = rules.country_key(rules.first_of(F.col("countries_raw")))
    found = rows.withColumn("country_key", key).join(by_alias, F.col("country_key") == F.col("lookup_key"), "left")
    code = F.coalesce("alias_iso", F.when(F.col("country_key").rlike("^[a-z]{2}$"), F.upper("country_key")), F.lit("XX"))
    named = found.withColumn("country_iso_code", code).join(by_code, F.col("country_iso_code") == F.col("lookup_iso"), "left")
    named = named.withColumn("primary_country", F.coalesce("alias_name", "iso_name", F.lit("Unknown Country")))
    return named.drop("country_key", "lookup_key", "alias_iso", "alias_name", "lookup_iso", "iso_name")


def enriched(rows: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Rules that need cleansed columns, and the silver column order."""
    c = F.col
    derived = rows.withColumns(
        {
            "sugar_tier": rules.tier(c("sugars_100g"), rules.SUGAR_STEPS),
            "fat_tier": rules.tier(c("fat_100g"), rules.FAT_STEPS),
            "salt_tier": rules.tier(c("salt_100g"), rules.SALT_STEPS),
            "protein_density_score": rules.protein_density(c("proteins_100g"), c("energy_kcal_per_100g")),
            "completeness_score": rules.completeness([c(n) for n in rules.COMPLETENESS_FIELDS]),
            "is_nutritional_data_complete": rules.any_known([c(n) for n in ("energy_kcal_per_100g", *MACROS, "salt_100g")]),
            "silver_processed_at": F.current_timestamp() if processed_at is None else processed_at,
        }
    )
    return derived.withColumn("data_quality_tier", rules.quality_tier(c("completeness_score"))).select(*SILVER_COLUMNS)


def latest(rows: DataFrame, keys: Sequence[str] = (KEY,), revision: str = REVISION, ties: Sequence[str] | None = None) -> DataFrame:
    """The latest revision of each key; of equal revisions the one whose other columns are largest, in order.

    A row number that is compared with 1 is cut off before the shuffle, so a key with very many
    revisions sends one row a task.
    """
    ties = [n for n in rows.columns if n not in keys and n != revision] if ties is None else ties
    order = [F.col(n).desc_nulls_last() for n in (revision, *ties)]
    numbered = rows.withColumn("revision_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("revision_number = 1").drop("revision_number")


def newest(rows: DataFrame, keys: Sequence[str] = (KEY,), revision: str = REVISION) -> DataFrame:
    """All rows of each key's largest revision, cut down before the shuffle, so that rules run on few rows."""
    ranked = rows.withColumn("revision_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(revision).desc_nulls_last())))
    return ranked.filter("revision_rank = 1").drop("revision_rank")


def refined(rows: DataFrame, lookup: DataFrame, processed_at: Column | None = None, same_key: bool = True, ties: Sequence[str] | None = None) -> DataFrame:
    """Flat rows to the latest cleansed row of each barcode.

    Older revisions go first, the rules see what is left, and ties are then broken by cleansed columns, within the
    partitions that there are: one shuffle in all.
    """
    return latest(enriched(with_country(cleansed(newest(rows)), lookup, same_key), processed_at), ties=ties)


def silver(bronze: DataFrame, lookup: DataFrame, processed_at: Column | None = None, same_key: bool = True) -> DataFrame:
    """Bronze rows to the latest cleansed row of each barcode."""
    return refined(flat(products(bronze)), lookup, processed_at, same_key)


def run_silver(bronze: DataFrame, lookup: DataFrame, run_id: str | None = None, backfill: bool | str = False, **more) -> DataFrame:
    """Silver rows of one run, or, with backfill, of all; one of both must be asked for, backfill wins."""
    everything = backfill if isinstance(backfill, bool) else str(backfill).strip().lower() in ("1", "true", "yes", "on")
    if not everything and not (run_id or "").strip():
        raise ValueError("give a run_id or ask for a backfill")
    rows = bronze if everything else bronze.filter(F.col("ingest_run_id") == run_id)
    require_rows(rows, "bronze" if everything else f"bronze of run {run_id}")
    require_rows(products(rows), "products of these pages")
    return silver(rows, lookup, **more)
