"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bm25, decontamination, exact_dedup, fill_in_middle, html_text, mixing, near_dedup, packing, pseudonyms, quality, token_counts, toxicity, view_tree
from larder.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query()
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b WHERE 100 * n >= 85 * (len(s.s) + len(t.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
""")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the near-duplicate component it belongs to."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


PUBLIC_KEY = "public"


@query()
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by format-preserving pseudonyms.

    The key is the session's larder.pseudonyms.key; without one, as in tests, a public key that protects nothing.
    """
    key = spark.conf.get("larder.pseudonyms.key", PUBLIC_KEY)
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), key).select("doc_id", "lang", "source", "text", "n_values")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus totals for every context limit that is some document's length."""
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH n AS (SELECT doc_id, sha256({ASCII_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, the copy of it that stays and how many there are."""
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it is accepted."""
    return quality.rated(table(spark, sf_dir, "documents"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the labels that aren't held out."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(mixing.ORACLE)
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus remixed: sources weighted by the square root of their size, copies in a global random order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs)


@query(r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf) AS words FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS n, greatest(1.0, (SELECT count(*) FROM words) / count(*)) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM counts, whole GROUP BY term),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(weight * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * words / mean))), 9) AS score
  FROM counts q JOIN idf ON idf.term = q.term JOIN counts d ON d.term = q.term JOIN lengths ON lengths.doc_id = d.doc_id CROSS JOIN whole
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op10_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whose id is divisible by 50, the ten best of all documents, searched with its whole text."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, asked)


_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH iw AS (SELECT item_id, {_WORDS.format(ASCII_LOWER)} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(ASCII_LOWER)} AS w FROM documents),
placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM dw),
ahead AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM placed),
seen AS (SELECT r, i, n, array_to_string(l[1:n], ' ') AS x FROM ahead, (SELECT DISTINCT n FROM windows) WHERE len(l) >= n),
found AS (SELECT r, i, seen.n, item_id FROM seen JOIN windows ON seen.n = windows.n AND seen.x = windows.x),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""")
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document lie in occurrences of the benchmark's windows, and of which items."""
    rows = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"""
_LIVE = lambda name, text, table: f"""{name}_h AS (SELECT *, {_CRC32.format(text)} AS h FROM {table}),
{name} AS (SELECT b.batch, t.* EXCLUDE (h) FROM {name}_h t, batches b WHERE coalesce(h % 5 >= h // 5 % 5, true) OR (b.batch >= h % 5 AND b.batch < h // 5 % 5))"""  # noqa: E731


@query(f"""
WITH batches AS (SELECT unnest(range(0, 5)) AS batch),
{_LIVE('c', "'c' || client_id", 'clients')}, {_LIVE('s', "'s' || sale_id", 'sales')}, {_LIVE('l', "'l' || sale_id || ':' || line_no", 'sale_lines')},
joined AS (SELECT l.batch, n_regionkey AS region, l.vendor_id AS part, s.client_id, l.item_id,
    CAST(floor(100 * amount + 0.5) AS BIGINT) * (100 - CAST(floor(100 * discount + 0.5) AS BIGINT)) AS revenue
  FROM l JOIN s ON l.sale_id = s.sale_id AND l.batch = s.batch JOIN c ON s.client_id = c.client_id AND s.batch = c.batch
  JOIN vendors v ON l.vendor_id = v.vendor_id AND c.nation_id = v.nation_id JOIN nation ON v.nation_id = n_nationkey
  WHERE amount IS NOT NULL AND n_regionkey IS NOT NULL)
SELECT CAST(batch AS INTEGER) AS batch, CAST(region AS INTEGER) AS region, part, count(*) AS n_lines, CAST(sum(revenue) AS BIGINT) AS revenue, min(revenue) AS min_revenue,
  count(DISTINCT client_id) AS n_clients, count(DISTINCT item_id) AS n_items
FROM joined GROUP BY ALL
""")
def op12_view_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of lines by region and part after each of five batches of insertions and deletions."""
    return view_tree.replayed(spark, *[table(spark, sf_dir, n) for n in ("sale_lines", "sales", "clients", "vendors", "nation")])


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS p, CAST('0x' || h[25:32] AS BIGINT) % 100 AS q FROM t),
f AS (SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle sample, and of the text rebuilt from it."""
    samples = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return fill_in_middle.restored(samples).select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
