"""The maintained view against a plain join of what is there after each batch."""

import math
import random
from collections import Counter

import pytest

from larder.llm import queries, view_tree
from larder.llm.view_tree import N, SalesView, signed
from tests.helpers import assert_same

LINES = "sale_id long, line_no int, vendor_id long, item_id long, amount double, discount double, kind string, n int"
SALES = "sale_id long, client_id long, total double"
CLIENTS = "client_id long, nation_id int, value string"
VENDORS, NATION = "vendor_id long, nation_id int, region int", "n_nationkey int, n_regionkey int, n_name string"

VENDOR_ROWS = [(0, 0, 9), (1, 1, 9), (2, 0, 9), (3, None, 9), (None, 0, 9)]
NATION_ROWS = [(0, 7, "a"), (1, 8, "b"), (2, None, "c"), (None, 7, "d")]


def test_query_equals_sql(spark, tiny):
    assert_same(queries.QUERIES["op12_view_tree"](spark, tiny), queries.ORACLES["op12_view_tree"], tiny)


def revenue(amount, discount):
    return None if discount is None else math.floor(100 * amount + 0.5) * (100 - math.floor(100 * discount + 0.5))


def expected(lines, sales, clients):
    """Counters of rows to the rows of the view."""
    groups = {}
    for (sale, _, vendor, item, amount, discount, *_), n in lines.items():
        for (sale2, client, _), m in sales.items():
            for (client2, nation, _), k in clients.items():
                if None in (sale, vendor, amount, client) or sale != sale2 or client != client2:
                    continue
                for v, vn, _ in VENDOR_ROWS:
                    for key, region, _ in NATION_ROWS:
                        if v == vendor and vn is not None and vn == nation == key and region is not None:
                            groups.setdefault((region, vendor), []).append((n * m * k, revenue(amount, discount), client, item))
    out = set()
    for key, rows in groups.items():
        known = [(n, r) for n, r, _, _ in rows if r is not None and n]
        if sum(n for n, *_ in rows):
            total = sum(n * r for n, r in known) if known else None
            there = [x for x in rows if x[0]]
            out.add((*key, sum(n for n, *_ in rows), total, min((r for _, r in known), default=None), len({c for _, _, c, _ in there}), len({i for *_, i in there} - {None})))
    return out


def changes(rng, table, make, steps):
    """A batch of insertions and deletions of rows that are there."""
    signed_rows = []
    for _ in range(steps):
        if table and rng.random() < 0.4:
            row = rng.choice(sorted(table.elements(), key=str))
            table[row] -= 1
            if not table[row]:
                del table[row]
            signed_rows.append((*row, -1))
        else:
            row = make()
            table[row] += 1
            signed_rows.append((*row, 1))
    return signed_rows


@pytest.mark.parametrize("compact", [1, 16])
def test_random_batches(spark, compact):
    rng = random.Random(compact)
    view = SalesView(spark, spark.createDataFrame(VENDOR_ROWS, VENDORS), spark.createDataFrame(NATION_ROWS, NATION), compact)
    lines, sales, clients = Counter(), Counter(), Counter()
    some = lambda *xs: rng.choice(xs)
    make = {
        "lines": (lines, lambda: (some(1, 2, 3, None), 1, some(0, 1, 2, 3, None), some(5, 6, None), some(1.0, 2.5, None), some(0.0, 0.1, None), "x", 1), LINES),
        "sales": (sales, lambda: (some(1, 2, 3, None), some(10, 11, None), 1.0), SALES),
        "clients": (clients, lambda: (some(10, 11, None), some(0, 1, 2, None), "y"), CLIENTS),
    }
    assert view.result().count() == 0
    kept = Counter()
    for batch in range(5):
        given = {}
        for name, (table, one, schema) in make.items():
            rows = changes(rng, table, one, 0 if batch == 3 and name == "sales" else 12 if name == "lines" else 4)
            given[name] = view_tree.LEAVES[name](spark.createDataFrame(rows, f"{schema}, {N} long"), N)
        if batch == 2:
            del given["clients"]
            clients.clear()  # takes back what was drawn
            clients.update(kept)
        view.apply(**given)
        kept = Counter(clients)
        assert {tuple(r) for r in view.result().select("region", "part", "n_lines", "revenue", "min_revenue", "n_clients", "n_items").collect()} == expected(lines, sales, clients)
    assert all(len(log.tables) <= compact for log in view.tree.logs.values())
    view.drop()


def test_a_minimum_comes_back_when_the_least_row_goes(spark):
    view = SalesView(spark, spark.createDataFrame(VENDOR_ROWS, VENDORS), spark.createDataFrame(NATION_ROWS, NATION))
    line = lambda amount, n: view_tree.lines_leaf(spark.createDataFrame([(1, 1, 0, 5, amount, 0.0, "x", 1, n)], f"{LINES}, {N} long"), N)
    view.apply(sales=view_tree.sales_leaf(signed(spark.createDataFrame([(1, 10, 1.0)], SALES)), N), clients=view_tree.clients_leaf(signed(spark.createDataFrame([(10, 0, "y")], CLIENTS)), N))
    for amount, n, least in ((3.0, 1, 30000), (1.0, 1, 10000), (1.0, 1, 10000), (1.0, -1, 10000), (1.0, -1, 30000), (3.0, -1, None)):
        view.apply(lines=line(amount, n))
        assert [r.min_revenue for r in view.result().collect()] == ([least] if least else [])
    with pytest.raises(ValueError):
        view.apply(vendors=line(1.0, 1))


def test_hot_sales_and_clients_are_split(spark):
    """With 90 % of all rows on one sale and client, both joins are marked as skewed."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    lines = spark.range(40_000).selectExpr("IF(id % 10 < 9, 7, id) AS sale_id", "id % 3 AS vendor_id", "id AS item_id", "id AS revenue", f"1L AS {N}")
    sales = spark.range(40_000).selectExpr("id AS sale_id", "IF(id % 10 < 9, 7, id) AS client_id", f"1L AS {N}")
    clients = spark.range(40_000).selectExpr("id AS client_id", "CAST(id % 2 AS INT) AS nation_id", f"1L AS {N}")
    from larder.llm.common import stored

    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        tree = view_tree.ViewTree(view_tree.TREE, {"vendors": spark.createDataFrame(VENDOR_ROWS, VENDORS).filter("nation_id IS NOT NULL AND vendor_id IS NOT NULL").select("vendor_id", "nation_id")})
        change = tree.changed({k: stored(v.repartition(16), "in") for k, v in (("lines", lines), ("sales", sales), ("clients", clients))})
        rows = view_tree.lifted(change.withColumnRenamed("vendor_id", "part"), ("nation_id", "part"))
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
