"""Lookup tables: country aliases and Nutri-Score grades."""

from __future__ import annotations

import csv
import unicodedata
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import rules
from larder.sources.schemas import GRADE_LOOKUP, LOOKUP

# The grades with their score bands.
GRADE_ROWS = [
    ("A", -100, -1, "Excellent nutritional quality", "Green"),
    ("B", 0, 2, "Good nutritional quality", "Yellow"),
    ("C", 3, 10, "Average nutritional quality", "Orange"),
    ("D", 11, 18, "Poor nutritional quality", "Red"),
    ("E", 19, 999, "Very poor nutritional quality", "Dark_red"),
    ("Unknown", None, None, "Score not available", "Gray"),
]


def grade_lookup(spark: SparkSession, csv_path: str | None = None) -> DataFrame:
    """The grade table, from a CSV file with header or built in."""
    if csv_path:
        return spark.read.schema(GRADE_LOOKUP).option("header", True).csv(csv_path)
    return spark.createDataFrame(GRADE_ROWS, GRADE_LOOKUP)


def iso_countries(spark: SparkSession) -> list[tuple[str, str]]:
    """ISO 3166 codes with English names, as the JVM knows them, and XX."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    rows = [(code, locale("", code).getDisplayCountry(english)) for code in locale.getISOCountries()]
    return rows + [("XX", "Unknown Country")]


#: Languages whose names of countries become aliases; of one that two countries share none does.
LANGUAGES = "de fr es it nl pt pl sv da nb fi cs sk sl hr hu ro bg el ru uk mk sr tr ar he ja ko zh et lv lt ca".split()

# What products call countries beyond the names and codes of ISO 3166, by code.
SAID = {
    "BE": ["belgie"],
    "CH": ["schweiz", "suisse"],
    "CI": ["ivory coast", "cote d'ivoire"],
    "CV": ["cape verde"],
    "CZ": ["czech republic", "česko"],
    "DE": ["getränke", "wasser"],
    "ES": ["espana"],
    "GB": ["uk", "u.k.", "great britain", "england", "scotland", "wales"],
    "IS": ["island"],
    "KR": ["korea", "republic of korea"],
    "LA": ["laos"],
    "MK": ["macedonia"],
    "MM": ["burma"],
    "NL": ["holland"],
    "NO": ["norwegan", "norwegie"],
    "PL": ["nabiał", "nabial"],
    "RO": ["roemenie"],
    "SZ": ["swaziland"],
    "TL": ["east timor"],
    "TR": ["turkey"],
    "US": ["u.s.", "u.s.a.", "united states of america"],
    "VI": ["virgin islands of the united states"],
    "VN": ["viet nam"],
    "XX": ["world", "unknown"],
}


def _plain(name: str) -> str:
    """A name without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))


def exonyms(spark: SparkSession, countries: Iterable[tuple[str, str]], languages: Iterable[str] = LANGUAGES) -> list[tuple[str, str, str]]:
    """alias, code and name: what countries are called in other languages, with and without accents, their three-letter codes, and SAID."""
    names, meant = dict(countries), {}
    locale = spark._jvm.java.util.Locale
    tongues = [locale(x) for x in languages]
    for code in names:
        place = locale("", code)
        if code == "XX":
            continue
        for said in {place.getISO3Country(), *(place.getDisplayCountry(t) for t in tongues)}:
            for alias in {said.lower(), _plain(said.lower())}:
                meant.setdefault(alias, set()).add(code)
    own = {n.strip().lower() for n in names.values()} | {c.lower() for c in names}
    rows = {alias: next(iter(codes)) for alias, codes in meant.items() if len(codes) == 1 and alias and alias not in own}
    rows |= {alias: code for code, said in SAID.items() for alias in said}
    return [(alias, code, names.get(code, code)) for alias, code in sorted(rows.items())]


def alias_rows(countries: Iterable[tuple[str, str]], extra: Iterable[tuple[str, str, str]] = ()) -> list[tuple[str, str, str]]:
    """alias, code and name: the code, the name and its slug, each also tagged en:; extra rows win. Sorted by code, then alias."""
    rows: dict[str, tuple[str, str]] = {}
    for code, name in countries:
        low = name.strip().lower()
        forms = {low, "-".join(low.split())}
        for alias in forms | {f"en:{f}" for f in forms} | {code.lower()}:
            rows[alias] = code.upper(), name.strip()
    for alias, code, name in extra:
        if (alias := alias.strip().lower()) and not alias.startswith("#"):
            rows[alias] = code.strip().upper(), name.strip()
    return sorted(((a, c, n) for a, (c, n) in rows.items()), key=lambda r: (r[1], r[0]))


def custom_rows(path: str | Path) -> list[tuple[str, str, str]]:
    """Extra aliases from a CSV file with header alias, iso_code, display_name; none if there is no file."""
    if not Path(path).is_file():
        return []
    with open(path, encoding="utf-8", newline="") as f:
        return [(r["alias"] or "", r["iso_code"] or "", r["display_name"] or "") for r in csv.DictReader(f)]


def write_lookup(path: str | Path, rows: Iterable[tuple[str, str, str]]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([("alias", "iso_code", "display_name"), *rows])


def country_lookup(spark: SparkSession, csv_path: str) -> DataFrame:
    """The alias table of a CSV file, one row per alias."""
    if "://" not in csv_path and not Path(csv_path).exists():
        raise FileNotFoundError(csv_path)
    read = spark.read.schema(LOOKUP).option("header", True).csv(csv_path)
    rows = read.select(F.lower(F.trim("alias")).alias("alias"), F.upper(F.trim("iso_code")).alias("iso_code"), F.trim("display_name").alias("display_name"))
    return rows.filter("alias <> ''").groupBy("alias").agg(F.min(F.struct("iso_code", "display_name")).alias("r")).select("alias", "r.*")


def keyed(lookup: DataFrame, same_key: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables to join with: by alias key, and by code. Fresh column names keep them apart.

    same_key: aliases are compared in the form in which country names are; without it, as written, by
    which aliases with a language tag or a dash never match.
    """
    alias = rules.country_key(F.col("alias")) if same_key else F.col("alias")
    by_alias = lookup.groupBy(alias.alias("lookup_key")).agg(F.min(F.struct("iso_code", "display_name")).alias("r")).select("lookup_key", F.col("r.iso_code").alias("alias_iso"), F.col("r.display_name").alias("alias_name"))
    by_code = lookup.groupBy(F.col("iso_code").alias("lookup_iso")).agg(F.min("display_name").alias("iso_name"))
    return by_alias, by_code
