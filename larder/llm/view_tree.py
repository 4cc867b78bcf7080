"""Incremental maintenance of a join view by a factorised view tree.

A tree's leaves are relations, its inner nodes join two children and keep the columns that are still needed,
so a join variable is gone (marginalised) as soon as nothing above asks for it. Rows carry a multiplicity, which may be negative:
a batch of changes is a set of signed rows at some leaves, and goes from leaf to root by
d(L * R) = dL * (R + dR) + L * dR. Nothing is computed again from whole relations.

What a node keeps of a child is a log: the child's changes, each a stored table, in the order they came.
Joins are linear, so a log is read as it is, without adding up; when it has more than COMPACT tables it is written
as one. A child is logged only if its sibling can change: with static dimensions, facts aren't kept twice.

`SalesView` is a view on such a tree: lines * vendors on vendor_id, sales * clients on client_id, both on
(sale_id, nation_id). There sale_id and client_id leave the keys, and what the result needs of the rest becomes payload, in rows
(kind, value, n, total) of each (nation_id, part): kind COUNT is an element of the ring of count and sum;
REVENUE, ITEM and CLIENT are relations, a multiset of revenues and counted ids, from which a minimum and distinct
counts survive deletions. The root joins nation, marginalises nation_id to region and adds up.

Scale: a batch shuffles its own rows, and of each log the columns of one join. Both sides of a join are plain exchanges,
so Spark splits a hot sale, client or vendor; payloads are summed on the map side first, and a group's payload is
many rows, never one. Nothing is collected; small dimensions are broadcast where Spark's threshold says so. All state is
stored in the shared folder, so lost executors cost a reread.

Defined cases: rows with a null key, amount, region or part join nothing; a null discount gives a null revenue, which counts as
a line and is left out of sum and minimum (both null where a group has no other); equal rows all count; null item
ids aren't counted; deleting a row that isn't there leaves a negative multiplicity, which a later insertion
evens out; groups without lines aren't returned; empty batches and empty tables change nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import OWN, dropped, stored
from larder.storage import fresh

#: The column of multiplicities: how often a row was inserted, less how often it was deleted.
N = f"{OWN}n"
#: Changes in a log from which on it is added up.
COMPACT = 16


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when a query ends, not when the driver happens to collect its garbage: what is
    kept of these queries is what they store."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@dataclass(frozen=True)
class Node:
    """A join of two children (leaves are names of relations) on some columns, of which these are kept."""

    left: Node | str
    right: Node | str
    on: tuple[str, ...]
    keep: tuple[str, ...]

    def leaves(self) -> set[str]:
        return leaves(self.left) | leaves(self.right)


def leaves(node: Node | str) -> set[str]:
    return {node} if isinstance(node, str) else node.leaves()


def signed(rows: DataFrame, n: int | Column = 1) -> DataFrame:
    """Rows to insert (1) or to delete (-1)."""
    return rows.withColumn(N, (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def added_up(rows: DataFrame) -> DataFrame:
    """One row for each different one, without those that are gone."""
    names = [c for c in rows.columns if c != N]
    return rows.groupBy(*names).agg(F.sum(N).alias(N)).filter(F.col(N) != 0)


@dataclass
class Log:
    """A view as the stored tables of its changes."""

    compact: int = COMPACT
    tables: list[DataFrame] = field(default_factory=list)

    def add(self, change: DataFrame) -> None:
        self.tables.append(change)

    def settle(self) -> None:
        """Adds the log up if it is long. Nothing may read its tables any more."""
        if len(self.tables) > self.compact:
            whole, old = stored(added_up(self.rows()), "view"), self.tables
            self.tables = [whole]
            for t in old:
                dropped(t)

    def rows(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.tables) if self.tables else None


class ViewTree:
    """Keeps what a tree of joins needs to turn changes of its leaves into changes of its root."""

    def __init__(self, root: Node, static: dict[str, DataFrame], compact: int = COMPACT) -> None:
        self.root, self.static = root, {k: signed(v) for k, v in static.items()}
        self.logs: dict[Node | str, Log] = {}
        self._plan(root, compact)

    def _changes(self, node: Node | str) -> bool:
        return bool(leaves(node) - set(self.static))

    def _plan(self, node: Node | str, compact: int) -> None:
        if isinstance(node, str):
            return
        for child, sibling in ((node.left, node.right), (node.right, node.left)):
            if self._changes(child) and self._changes(sibling):
                self.logs[child] = Log(compact)
            self._plan(child, compact)

    def _whole(self, node: Node | str) -> DataFrame | None:
        """A child as it is now: its log, or a static relation."""
        if node in self.logs:
            return self.logs[node].rows()
        if isinstance(node, str):
            return self.static[node]
        return self._joined(node, self._whole(node.left), self._whole(node.right))

    def _joined(self, node: Node, left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed(N, f"{N}2")
        both = left.join(other, list(node.on))
        return both.select(*node.keep, (F.col(N) * F.col(f"{N}2")).alias(N))

    def _change(self, node: Node | str, changes: dict[str, DataFrame]) -> DataFrame | None:
        if isinstance(node, str):
            return changes.get(node)
        left, right = self._change(node.left, changes), self._change(node.right, changes)
        before = self.logs[node.left].rows() if node.left in self.logs else None
        if before is None and node.left not in self.logs and right is not None:
            before = self._whole(node.left)
        for child, change in ((node.left, left), (node.right, right)):
            if change is not None and child in self.logs:
                change = stored(change, "delta")
                self.logs[child].add(change)
                left, right = (change, right) if child is node.left else (left, change)
        parts = []
        if left is not None and (now := self._whole(node.right)) is not None:
            parts.append(self._joined(node, left, now))
        if right is not None and before is not None:
            parts.append(self._joined(node, before, right))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def changed(self, changes: dict[str, DataFrame]) -> DataFrame | None:
        """The root's change, signed rows, after these changes of leaves. It reads the logs: store it, then `settle`."""
        unknown = set(changes) - self.root.leaves() | set(changes) & set(self.static)
        if unknown:
            raise ValueError(f"{', '.join(sorted(unknown))} can't change in this tree")
        return self._change(self.root, changes)

    def settle(self) -> None:
        for log in self.logs.values():
            log.settle()

    def drop(self) -> None:
        for log in self.logs.values():
            for t in log.tables:
                dropped(t)
            log.tables = []


COUNT, REVENUE, ITEM, CLIENT = range(4)
PAYLOAD = ("kind", "value")

TREE = Node(
    Node("lines", "vendors", ("vendor_id",), ("sale_id", "nation_id", "vendor_id", "item_id", "revenue")),
    Node("sales", "clients", ("client_id",), ("sale_id", "nation_id", "client_id")),
    ("sale_id", "nation_id"),
    ("nation_id", "vendor_id", "client_id", "item_id", "revenue"),
)


def lines_leaf(lines: DataFrame, *more: str) -> DataFrame:
    """Lines as the tree takes them: revenue in ten-thousandths, from amount and discount in whole hundredths."""
    hundredths = lambda c: F.floor(100 * F.col(c) + F.lit(0.5)).cast("long")
    revenue = hundredths("amount") * (100 - hundredths("discount"))
    known = lines.filter("sale_id IS NOT NULL AND vendor_id IS NOT NULL AND amount IS NOT NULL")
    return known.select("sale_id", "vendor_id", "item_id", revenue.alias("revenue"), *more)


def sales_leaf(sales: DataFrame, *more: str) -> DataFrame:
    return sales.filter("sale_id IS NOT NULL AND client_id IS NOT NULL").select("sale_id", "client_id", *more)


def clients_leaf(clients: DataFrame, *more: str) -> DataFrame:
    return clients.filter("client_id IS NOT NULL AND nation_id IS NOT NULL").select("client_id", "nation_id", *more)


LEAVES = {"lines": lines_leaf, "sales": sales_leaf, "clients": clients_leaf}


def lifted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Joined rows as payload rows of their key (by), summed: (by, kind, value, n, total)."""
    n = F.col(N)
    element = lambda kind, value, total: F.struct(F.lit(kind).cast("byte").alias("kind"), value.cast("long").alias("value"), n.alias("n"), total.alias("total"))
    no = F.lit(0).cast("long")
    payload = F.array(
        element(COUNT, no, n * F.coalesce(F.col("revenue"), no)),
        element(REVENUE, F.col("revenue"), no),
        element(ITEM, F.col("item_id"), no),
        element(CLIENT, F.col("client_id"), no),
    )
    return summed(rows.select(*by, F.inline(payload)).filter("value IS NOT NULL"), by)


def summed(payload: DataFrame, by: Sequence[str]) -> DataFrame:
    """Payload rows added up, without those that are zero."""
    sums = payload.groupBy(*by, *PAYLOAD).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.filter("n <> 0 OR total <> 0")


class SalesView:
    """Lines, revenue, least revenue, clients and items by region and part (a line's vendor), kept up under insertions and deletions."""

    def __init__(self, spark: SparkSession, vendors: DataFrame, nation: DataFrame, compact: int = COMPACT) -> None:
        self.spark = spark
        self.tree = ViewTree(TREE, {"vendors": vendors.filter("vendor_id IS NOT NULL AND nation_id IS NOT NULL").select("vendor_id", "nation_id")}, compact)
        self.nation = nation.filter("n_nationkey IS NOT NULL AND n_regionkey IS NOT NULL").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region"))
        self.root: DataFrame | None = None

    def apply(self, **changes: DataFrame) -> None:
        """Takes signed rows of lines, sales and clients (see LEAVES and signed), all at once."""
        with brief_shuffles(self.spark):
            change = self.tree.changed(changes)
        if change is None:
            return
        payload = lifted(change.withColumnRenamed("vendor_id", "part"), ("nation_id", "part"))
        delta = payload.join(self.nation, "nation_id").select("region", "part", *PAYLOAD, "n", "total")
        before = self.root
        with brief_shuffles(self.spark):
            self.root = stored(summed(delta if before is None else before.unionByName(delta), ("region", "part")), "root")
        self.tree.settle()
        if before is not None:
            dropped(before)

    def result(self) -> DataFrame:
        """region, part, n_lines, revenue, min_revenue, n_clients and n_items of each group that has lines."""
        if self.root is None:
            empty = "region int, part long, n_lines long, revenue long, min_revenue long, n_clients long, n_items long"
            return self.spark.createDataFrame([], empty)
        of = lambda kind: F.col("kind") == kind
        there = lambda kind: of(kind) & (F.col("n") > 0)
        priced = F.count_if(there(REVENUE)) > 0
        groups = self.root.groupBy("region", "part").agg(
            F.coalesce(F.sum(F.when(of(COUNT), F.col("n"))), F.lit(0)).alias("n_lines"),
            F.when(priced, F.sum(F.when(of(COUNT), F.col("total")))).alias("revenue"),
            F.min(F.when(there(REVENUE), F.col("value"))).alias("min_revenue"),
            F.count_if(there(CLIENT)).alias("n_clients"),
            F.count_if(there(ITEM)).alias("n_items"),
        )
        return groups.filter("n_lines > 0")

    def drop(self) -> None:
        """Deletes the stored state."""
        self.tree.drop()
        if self.root is not None:
            dropped(self.root)
            self.root = None


BATCH, START = f"{OWN}batch", -1


def moves(name: Column, batches: int) -> Column:
    """The batches (START for the time before them) in which a row comes and goes, with its multiplicity, from the CRC-32 of its name.

    Rows whose first batch isn't before their last, or that have no name, are there from the start and stay.
    """
    code = F.crc32(name) % (batches * batches)
    first, last = code % batches, F.floor(code / batches)
    move = lambda batch, n: F.struct(batch.cast("int").alias(BATCH), F.lit(n).cast("long").alias(N))
    stays = [a + batches * d for d in range(batches) for a in range(d, batches)]
    return F.when(code.isNull() | code.isin(stays), F.array(move(F.lit(START), 1))).otherwise(F.array(move(first, 1), move(last, -1)))


def arrivals(rows: DataFrame, name: Column, leaf: Callable[..., DataFrame], batches: int) -> dict[int, DataFrame]:
    """The signed rows of a leaf by batch: names are hashed in one pass, and each batch is then read by itself."""
    spark, path = rows.sparkSession, fresh(rows.sparkSession, "arrivals")
    history = leaf(rows.withColumn(BATCH, moves(name, batches)), BATCH)
    history = history.select(*[c for c in history.columns if c != BATCH], F.inline(BATCH))
    schema = T.StructType([f for f in history.schema if f.name != BATCH])
    history.write.partitionBy(BATCH).parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)}
    return {b: spark.read.schema(schema).parquet(f"{path}/{BATCH}={b}") for b in range(START, batches) if f"{BATCH}={b}" in there}


def replayed(spark: SparkSession, lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame, nation: DataFrame, batches: int = 5) -> DataFrame:
    """The view after each batch of a history that the rows' names decide (see moves), with its number in batch."""
    text = lambda c: F.col(c).cast("string")
    names = {"lines": F.concat(F.lit("l"), text("sale_id"), F.lit(":"), text("line_no")), "sales": F.concat(F.lit("s"), text("sale_id")), "clients": F.concat(F.lit("c"), text("client_id"))}
    coming = {k: arrivals(rows, names[k], LEAVES[k], batches) for k, rows in (("lines", lines), ("sales", sales), ("clients", clients))}
    view = SalesView(spark, vendors, nation)
    results = []
    for batch in range(START, batches):
        now = {k: v[batch] for k, v in coming.items() if batch in v}
        view.apply(**now)
        for rows in now.values():
            dropped(rows)
        if batch != START:
            with brief_shuffles(spark):
                results.append(stored(view.result().select(F.lit(batch).alias("batch"), "*"), "result"))
    view.drop()
    return reduce(DataFrame.unionByName, results)
