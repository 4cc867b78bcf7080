"""Golden rows of every cleansing rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larder.functions import rules


def results(spark, kinds, rows, column):
    """The rule's values for rows of inputs; the last item of each row is what is expected."""
    n = len(kinds)
    names = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{a} {k}" for a, k in zip(names, kinds, strict=True)))
    got = df.select("i", column(*[F.col(x) for x in names]).alias("out")).orderBy("i").collect()
    return [r["out"] for r in got], [r[n] for r in rows]


CASES = {
    "energy": (("double", "double"), rules.energy_kcal, [(539.0, 2255.0, 539.0), (None, 2255.0, 539.0), (2255.0, None, 539.0), (2255.0, 4000.0, None), (0.0, 418.4, 100.0), (5000.0, None, None), (-5.0, None, None), (None, None, None)]),
    "sugar": (("double",), lambda c: rules.tier(rules.nutrient(c), rules.SUGAR_STEPS), [(4.94, "Low"), (4.95, "Medium"), (12.54, "Medium"), (12.55, "High"), (None, "Unknown")]),
    "nutrient": (("double",), rules.nutrient, [(100.0, 100.0), (100.04, None), (-0.1, None), (0.0, 0.0), (None, None)]),
    "sodium": (("double", "double"), lambda na, salt: rules.sodium(na, rules.nutrient(salt, 2)), [(None, 0.107, 0.04), (0.0, None, None), (0.456, 1.0, 0.46), (None, None, None)]),
    "protein": (("double", "double"), rules.protein_density, [(6.3, 539.0, 1.2), (1.0, 4.0, None), (None, 100.0, None), (0.0, 100.0, None)]),
    "nova": (("int",), rules.nova_label, [(1, "unprocessed"), (2, "culinary_ingredient"), (3, "processed"), (4, "ultra_processed"), (None, "unclassified"), (7, "unclassified")]),
    "nova title": (("string",), rules.nova_title, [("ultra_processed", "Ultra-processed"), ("other", "other"), (None, None)]),
    "ingredients": (("string",), rules.ingredient_count, [("a,b,,c", 4), ("", 0), (None, 0), (" ", 1)]),
    "recalculated": (("int",), rules.recalculated_grade, [(-1, "A"), (0, "B"), (2, "B"), (3, "C"), (10, "C"), (11, "D"), (18, "D"), (19, "E"), (None, "Unknown")]),
    "mismatch": (("string", "int"), lambda g, s: rules.grade_mismatch(rules.reported_grade(g), rules.recalculated_grade(s)), [("e", 26, False), ("a", 26, True), ("unknown", 26, False), (None, 26, False), ("a", None, False)]),
    "reported": (("string",), rules.reported_grade, [("b", "B"), ("not-applicable", "Not Applicable"), ("n/a", "Not Applicable"), ("  ", "Unknown"), (None, "Unknown"), ("foo bar", "Foo Bar"), ("UNKNOWN", "Unknown")]),
    "category": (("string",), rules.category, [("en:plant-based foods", "Plant Based Foods"), ("en:en:tea", "Tea"), ("Café", "Unknown Category"), (None, "Unknown Category"), ("en:", "")]),
    "tags": (("string",), rules.tag_list, [("en:milk,en:tree-nuts", "Milk, Tree Nuts"), ("a,,b", "A, , B"), ("FR:lait, de:ei,\ten:soy", "Lait, Ei, Soy"), (" en:x", "En:x"), ("a:b,12:c", "A:b, 12:c"), (" ", "Unknown"), (None, "Unknown")]),
    "name": (("string",), rules.product_name, [("m&amp;m", "M&m"), (None, "Unknown Product"), (" ", "Unknown Product")]),
    "ean": (("string",), rules.is_ean, [("4006381333931", True), (" 12345678 ", True), ("111", False), (None, False), ("1" * 15, False)]),
    "row hash": (("string", "long"), rules.row_hash, [("1", None, hashlib.sha256(b"1").hexdigest()), ("1", 2, hashlib.sha256(b"1|2").hexdigest())]),
    "brand key": (("string",), rules.label_key, [(None, hashlib.sha256(b"Unknown").hexdigest()), ("", hashlib.sha256(b"Unknown").hexdigest()), ("  ", hashlib.sha256(b"Unknown").hexdigest()), (" x ", hashlib.sha256(b"x").hexdigest())]),
    "filled": (("string",), rules.filled, [("Unknown Product", 0), ("n/a", 0), (" ", 0), (None, 0), ("unknownish", 1), ("x", 1)]),
    "whole": (("string",), rules.whole, [("4", 4), ("4.0", 4), ("x", None), ("", None), (None, None)]),
    "country key": (("string",), rules.country_key, [("en:guinea-bissau", "guinea bissau"), (" FR:en:Côte  d'Ivoire", "côte d'ivoire"), (None, None)]),
    "protein tier": (("double",), rules.protein_tier, [(10.0, "High"), (5.0, "Medium"), (4.9, "Low"), (None, "Unknown")]),
    "above": (("double", "double"), rules.above, [(2.0, 1.0, "Yes"), (1.0, 1.0, "No"), (None, 1.0, "Unknown"), (1.0, None, "Unknown")]),
    "first": (("string",), rules.first_of, [(" a , b", "a"), ("", ""), (None, None)]),
    "lookup grade": (("string",), rules.lookup_grade, [(" a ", "A"), ("x", "Unknown"), (None, "Unknown")]),
    "clamp kcal": (("double",), lambda c: rules.within(c, 0.0, 900.0, open_low=True), [(0.0, None), (900.0, 900.0), (900.1, None)]),
    "quality tier": (("int",), rules.quality_tier, [(6, "Complete"), (5, "Sparse")]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    kinds, column, rows = CASES[name]
    got, expected = results(spark, kinds, rows, column)
    assert got == expected


def test_completeness_counts_ten_fields():
    assert len(rules.COMPLETENESS_FIELDS) == 10 and rules.COMPLETE_FROM == 6


def test_numbers_are_what_a_cast_gives(spark):
    """The guard before the cast leaves out only what the cast makes null; words don't reach the cast, whose failures are slow."""
    texts = ["", " ", "none", "unknown", "12g", "1e3", " 7 ", "4.0", "-.5", "1d", "1f", "0x1p3", "inf", "+Inf", "-INF", "Infinity", "-infinity", "infinite", "NaN", "nan", "banana", "\u0661", "1,5", "--1", ".", "e", "\t2\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.number(F.col("t")).alias("got"), F.col("t").try_cast("double").alias("want"))
    assert [(r["t"], str(r["got"])) for r in rows.collect()] == [(r["t"], str(r["want"])) for r in rows.collect()]
    assert "RLIKE" in rows.select("got")._jdf.queryExecution().analyzed().toString().upper()
