"""Keyed upserts on plain Parquet: a growing hash directory of buckets, and numbered manifests.

A table is split by the hash of its keys. Its directory is an extendible hash: a bucket holds the rows whose hash ends in its
code, of so many bits as it is deep, and one that would get more than `bucket_rows` rows is split when it is written. A write
touches the buckets that its rows fall into and leaves the others where they are; rows are dealt out by a rebalance, which cuts a
large bucket into as many tasks as its bytes take, so neither a task nor a bucket grows with the table. A guarded merge deals old and
new rows out by buckets, large ones in slices of their hash, and merges them there: one shuffle and one sort, after which they are written.

Each version has a manifest: columns, keys, the directory with every bucket's rows and folder, and properties. The one with the
largest number is the table. A writer makes new folders and then adds the next manifest, complete and only if there is none
of that number (see `_published`). Where another writer was first, it looks at the newer versions: if these have left its
buckets and columns alone, its folders are put on top of them; if not, it merges its stored rows anew, on the
newest version. So writers at once all keep their rows, as if they had come one after the other. An overwrite fails instead.

Nothing is deleted that may still be wanted: with a manifest that is given up go the folders that it alone
names; folders that no manifest names (a writer at work, or one that failed) are left to `vacuum`, which goes by their age.

Columns have numbers, by which files know them. A batch may bring new columns, and wider types of old ones (whole to longer
whole, float to double); `rename` changes a name in the manifest alone. Readers ask for the numbers with the
newest types, so no footers are merged.

A table may have zones: the least and the largest value of some columns in each bucket's folder, kept in the manifest. `selected`
reads only the folders whose zones reach into the ranges asked for, `found` only the buckets that given keys fall into. As buckets
go by the keys' hash, a run that is spread over all keys is in every folder; zones save folders for the newest runs that touched
few buckets. Inside a folder, files are sorted by the columns with zones, so that Parquet's own statistics are of use in large ones.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.silver import KEY, REVISION, latest

#: Bits of a new table's directory, and rows from which on a bucket is split.
DEPTH, BUCKET_ROWS = 4, 4_000_000
#: Rows that a guarded merge has in a slice of a bucket.
SLICE_ROWS = 500_000
#: Merges of one upsert that others may make void; versions that stay.
TRIES, KEEP = 20, 5
MANIFESTS, DATA, STAGED, BUCKET, SLICE = "_manifests", "data", "staged", "larder_bucket", "larder_slice"
#: Values of the change column of a feed.
CHANGE, INSERTED, DELETED, BEFORE, AFTER = "change", "inserted", "deleted", "before", "after"


class Conflict(OSError):
    """Someone else wrote what this write was based on."""


def merged(existing: DataFrame, new: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """All of new, and the rows of existing whose key isn't in new. new has one row a key."""
    return existing.join(new.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(new)


def merged_latest(existing: DataFrame, new: DataFrame, keys: Sequence[str] = (KEY,), revision: str = REVISION) -> DataFrame:
    """As merged, but an older revision doesn't replace a newer one; in a tie, new wins."""
    both = existing.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return latest(both, keys, revision, ["is_new", *[n for n in new.columns if n not in keys and n != revision]]).drop("is_new")


@dataclass(frozen=True)
class Bucket:
    """The rows whose hash ends in code, of depth bits; in a folder below the table's, if there are any."""

    depth: int
    code: int
    rows: int = 0
    folder: str | None = None
    #: Column number, least and largest place (see _place) in the folder; None and None where all are null.
    zones: tuple[tuple[int, int | str | None, int | str | None], ...] = ()

    @property
    def number(self) -> int:
        """The code behind a leading one: different for all buckets of all depths."""
        return 1 << self.depth | self.code

    def split(self, times: int) -> list[Bucket]:
        return [Bucket(self.depth + times, self.code | i << self.depth) for i in range(1 << times)]


@dataclass(frozen=True)
class Manifest:
    """A version: its number, columns (number, name, type), keys, directory and properties."""

    number: int
    columns: tuple[tuple[int, str, str], ...]
    keys: tuple[str, ...]
    buckets: tuple[Bucket, ...]
    bucket_rows: int = BUCKET_ROWS
    properties: Mapping[str, str] = field(default_factory=dict)
    #: Numbers of the columns with zones.
    zones: tuple[int, ...] = ()

    @classmethod
    def parsed(cls, text: str) -> Manifest:
        m = json.loads(text)
        buckets = tuple(Bucket(**b | {"zones": tuple(map(tuple, b.get("zones", ())))}) for b in m["buckets"])
        return cls(m["number"], tuple(map(tuple, m["columns"])), tuple(m["keys"]), buckets, m["bucket_rows"], m["properties"], tuple(m.get("zones", ())))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, _type(kind)) for _, name, kind in self.columns])

    @property
    def folders(self) -> set[str]:
        return {b.folder for b in self.buckets if b.folder}

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.buckets)

    @property
    def zoned(self) -> list[tuple[int, str, str]]:
        """The columns with zones, as far as their types have places."""
        return [c for c in self.columns if c[0] in self.zones and _has_place(_type(c[2]))]


def _type(kind: str) -> T.DataType:
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": json.loads(kind), "nullable": True, "metadata": {}}]})[0].dataType


# Files.


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _statuses(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _names(spark: SparkSession, path: str) -> list[str]:
    return [s.getPath().getName() for s in _statuses(spark, path)]


def _deleted(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _published(spark: SparkSession, root: str, m: Manifest) -> bool:
    """Adds a complete manifest; False if there is one of that number.

    On local disks by a hard link, elsewhere by a rename that doesn't replace, both of which the file system
    decides at once (an object store needs a connector that has such a rename).
    """
    fs, target = _fs(spark, f"{root}/{MANIFESTS}/{m.number:09d}")
    _, draft = _fs(spark, f"{root}/{MANIFESTS}/.{m.number}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(asdict(m)).encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            jvm = spark._jvm
            once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, once)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the manifests, in order."""
    return sorted(int(n) for n in _names(spark, f"{root}/{MANIFESTS}") if n.isdigit())


def version(spark: SparkSession, root: str) -> int | None:
    """The number of the current version; None where there is no table."""
    return max(versions(spark, root), default=None)


def exists(spark: SparkSession, root: str) -> bool:
    return version(spark, root) is not None


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest:
    number = version(spark, root) if number is None else number
    if number is None:
        raise FileNotFoundError(root)
    fs, p = _fs(spark, f"{root}/{MANIFESTS}/{number:09d}")
    stream = fs.open(p)
    try:
        return Manifest.parsed(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


# Columns.


#: Types that values of the first become without loss.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_WIDER = {(a, b) for i, a in enumerate(_WHOLE) for b in _WHOLE[i + 1 :]} | {("float", "double"), ("int", "double"), ("smallint", "double")}


def _columns(known: Sequence[tuple[int, str, str]], schema: T.StructType) -> tuple[tuple[int, str, str], ...]:
    """The known columns, widened where schema is wider, and the new ones of schema."""
    out = {name: (number, name, kind) for number, name, kind in known}
    unused = max([0, *[n for n, _, _ in known]]) + 1
    for f in schema:
        if f.name not in out:
            out[f.name] = (unused, f.name, f.dataType.json())
            unused += 1
            continue
        number, name, kind = out[f.name]
        there, here = _type(kind).simpleString(), f.dataType.simpleString()
        if (there, here) in _WIDER:
            out[name] = (number, name, f.dataType.json())
        elif there != here and (here, there) not in _WIDER:
            raise ValueError(f"{name} is {there} in the table and {here} in the batch")
    return tuple(out.values())


def _aligned(df: DataFrame, columns: Sequence[tuple[int, str, str]]) -> DataFrame:
    """df in these columns; those that it lacks are null."""
    return df.select(*[(F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(_type(kind)).alias(name) for _, name, kind in columns])


#: Signs of a text that a zone keeps.
ZONE_SIGNS = 64


def _has_place(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)) or kind.simpleString() == "string"


def _place(c: Column, kind: T.DataType) -> Column:
    """A number or short text that never falls when the value grows: whole numbers, beginnings of texts, days, microseconds; for
    times without a zone their days."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_date(c.cast("date")).cast("long")
    return c.cast("long") if isinstance(kind, T.IntegralType) else F.substring(c, 1, ZONE_SIGNS)


def _zone_numbers(columns: Sequence[tuple[int, str, str]], names: Sequence[str], schema: T.StructType) -> tuple[int, ...]:
    """The numbers of these columns, which must have places."""
    for n in names:
        if n not in schema.names or not _has_place(schema[n].dataType):
            raise ValueError(f"{n} can't have zones")
    return tuple(number for number, name, _ in columns if name in names)


# Rows.


def _hash(schema: T.StructType, keys: Sequence[str]) -> Column:
    """The keys' hash; the same for a number of any width."""
    whole, broken = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)
    even = lambda k: F.col(f"`{k}`").cast("long" if isinstance(schema[k].dataType, whole) else "double" if isinstance(schema[k].dataType, broken) else schema[k].dataType)
    return F.xxhash64(*map(even, keys))


def _number(hashed: Column, buckets: Sequence[Bucket]) -> Column:
    """The number of the bucket of a hash: buckets of the commonest depth by default, those of other depths by their codes."""
    depths = Counter(b.depth for b in buckets)
    common = depths.most_common(1)[0][0]
    end = lambda d: hashed.bitwiseAND(F.lit((1 << d) - 1))
    number = lambda d: end(d).bitwiseOR(F.lit(1 << d))
    out = number(common)
    for d in depths:
        if d != common:
            out = F.when(end(d).isin([b.code for b in buckets if b.depth == d]), number(d)).otherwise(out)
    return out.cast("int")


def _read(spark: SparkSession, root: str, m: Manifest, buckets: Sequence[Bucket]) -> DataFrame:
    folders = sorted(b.folder for b in buckets if b.folder)
    if not folders:
        return spark.createDataFrame([], m.schema)
    inside = T.StructType([T.StructField(f"c{number}", _type(kind)) for number, _, kind in m.columns])
    rows = spark.read.schema(inside).parquet(*[f"{root}/{f}" for f in folders])
    return rows.select(*[F.col(f"c{number}").alias(name) for number, name, _ in m.columns])


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table, or one of its kept versions."""
    m = manifest(spark, root, number)
    return _read(spark, root, m, m.buckets)


#: A range's ends, both included; None leaves it open.
Range = tuple[object, object]


def _reaching(spark: SparkSession, m: Manifest, within: Mapping[str, Range]) -> list[Bucket]:
    """The buckets with rows that may lie in all ranges; what has no zone may."""
    kinds = {name: (number, _type(kind)) for number, name, kind in m.columns}
    zoned = {number for number, _, _ in m.zoned}
    asked = [(name, *ends) for name, ends in within.items() if kinds[name][0] in zoned]
    if not asked:
        return [b for b in m.buckets if b.folder]
    # The ends' places by the same expression as the rows' ones; constants, so there is no job.
    place = lambda name, end: _place(F.lit(end).cast(kinds[name][1]), kinds[name][1])
    places = spark.sql("SELECT 1").select(*[place(name, end) for name, *ends in asked for end in ends]).first()
    ranges = {kinds[name][0]: places[2 * i : 2 * i + 2] for i, (name, _, _) in enumerate(asked)}

    def reaches(b: Bucket) -> bool:
        known = {number: ends for number, *ends in b.zones}
        for number, (low, high) in ranges.items():
            if number in known:
                least, largest = known[number]
                if least is None or (low is not None and largest < low) or (high is not None and least > high):
                    return False
        return True

    return [b for b in m.buckets if b.folder and reaches(b)]


def selected(spark: SparkSession, root: str, within: Mapping[str, Range], number: int | None = None) -> DataFrame:
    """The rows whose columns lie in ranges (nulls lie in none); folders whose zones don't reach into them aren't read."""
    m = manifest(spark, root, number)
    rows = _read(spark, root, m, _reaching(spark, m, within))
    for name, (low, high) in within.items():
        c, kind = F.col(f"`{name}`"), m.schema[name].dataType
        rows = rows.filter(c.isNotNull())
        rows = rows if low is None else rows.filter(c >= F.lit(low).cast(kind))
        rows = rows if high is None else rows.filter(c <= F.lit(high).cast(kind))
    return rows


def found(wanted: DataFrame, root: str, number: int | None = None) -> DataFrame:
    """The rows whose keys are in wanted (nulls never are), from the buckets only that these fall into. Computes wanted twice."""
    spark = wanted.sparkSession
    m = manifest(spark, root, number)
    keys = _aligned(wanted, [c for c in m.columns if c[1] in m.keys]).dropna()
    hit = {r[BUCKET] for r in keys.select(_number(_hash(m.schema, m.keys), m.buckets).alias(BUCKET)).distinct().collect()}
    return _read(spark, root, m, [b for b in m.buckets if b.number in hit]).join(keys, list(m.keys), "left_semi")


def _write(df: DataFrame, root: str, m: Manifest, buckets: Sequence[Bucket]) -> list[Bucket]:
    """Writes rows that fall into these buckets of a directory (m's, with some replaced); returns them with rows and folders."""
    inside = df.select(*_inside(m), _number(_hash(m.schema, m.keys), buckets).alias(BUCKET))
    return _saved(inside.hint("rebalance", BUCKET), root, m, buckets)


def _inside(m: Manifest) -> list[Column]:
    return [F.col(f"`{name}`").alias(f"c{number}") for number, name, _ in m.columns]


def _saved(dealt: DataFrame, root: str, m: Manifest, buckets: Sequence[Bucket]) -> list[Bucket]:
    """Writes rows, as files have them and dealt out by their buckets."""
    folder = f"{DATA}/{uuid.uuid4().hex}"
    if m.zoned:
        dealt = dealt.sortWithinPartitions(BUCKET, *[f"c{number}" for number, _, _ in m.zoned])
    dealt.write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    return _counted(dealt.sparkSession, root, folder, m, buckets)


def _guarded(old: DataFrame, new: DataFrame, m: Manifest, buckets: Sequence[Bucket], revision: str, most: int) -> DataFrame:
    """What merged_latest gives, as files have it, dealt out by buckets, of which the largest has most rows: rows of a key are in one
    slice of one bucket, so the merge needs no shuffle of its own, and its order is the writer's."""
    hashed, slices = _hash(m.schema, m.keys), -(-most // SLICE_ROWS)
    place = {BUCKET: _number(hashed, buckets)}
    if slices > 1:
        place[SLICE] = F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(slices)).cast("int")
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1))).withColumns(place).repartition(*place)
    rows = latest(both, [*place, *m.keys], revision, ["is_new", *[n for n in new.columns if n not in m.keys and n != revision]])
    return rows.select(*_inside(m), BUCKET)


def _counted(spark: SparkSession, root: str, folder: str, m: Manifest, buckets: Sequence[Bucket]) -> list[Bucket]:
    """The buckets with the rows and zones of what was written: one row a bucket, of the footers and the columns with zones alone."""
    made = {}
    if any(n.startswith(f"{BUCKET}=") for n in _names(spark, f"{root}/{folder}")):
        inside = T.StructType([T.StructField(f"c{number}", _type(kind)) for number, _, kind in m.zoned]).add(BUCKET, T.IntegerType())
        ends = [end(_place(F.col(f"c{number}"), _type(kind))).alias(f"{name}{number}") for number, _, kind in m.zoned for name, end in (("least", F.min), ("largest", F.max))]
        counts = spark.read.schema(inside).parquet(f"{root}/{folder}").groupBy(BUCKET).agg(F.count("*").alias("rows"), *ends)
        made = {r[BUCKET]: {"rows": r["rows"], "zones": tuple((n, r[f"least{n}"], r[f"largest{n}"]) for n, _, _ in m.zoned)} for r in counts.collect()}
    return [replace(b, folder=f"{folder}/{BUCKET}={b.number}", **made[b.number]) if b.number in made else replace(b, rows=0, folder=None, zones=()) for b in buckets]


def _grown(bucket: Bucket, rows: int, most: int) -> list[Bucket]:
    """A bucket, or what it is split into to hold so many rows."""
    times = 0
    while rows > most << times:
        times += 1
    return bucket.split(times) if times else [bucket]


def _rewritten(spark: SparkSession, root: str, m: Manifest, made: list[Bucket]) -> list[Bucket]:
    """Splits buckets that turned out too large."""
    large = [b for b in made if b.rows > m.bucket_rows]
    if not large:
        return made
    again = _write(_read(spark, root, m, large), root, m, [c for b in large for c in _grown(b, b.rows, m.bucket_rows)])
    for b in large:
        _deleted(spark, f"{root}/{b.folder}")
    return [b for b in made if b not in large] + again


# Versions.


def _given_up(spark: SparkSession, root: str, keep: int) -> None:
    """Drops manifests but the last few, and the folders that only those name."""
    numbers = versions(spark, root)
    old = numbers[:-keep] if keep else []
    if not old:
        return
    kept = set().union(*[manifest(spark, root, n).folders for n in numbers[-keep:]])
    for n in old:
        try:
            mine = manifest(spark, root, n).folders
        except Py4JJavaError:
            continue  # another writer was faster
        _deleted(spark, f"{root}/{MANIFESTS}/{n:09d}")
        for f in mine - kept:
            _deleted(spark, f"{root}/{f}")


def vacuum(spark: SparkSession, root: str, hours: float = 168) -> list[str]:
    """Deletes folders that no manifest names and nobody has written for so long; no writer may take longer. Returns them."""
    used = set().union(*[manifest(spark, root, n).folders for n in versions(spark, root)])
    last = (time.time() - hours * 3600) * 1000
    gone = []
    for part in (DATA, STAGED):
        for top in _statuses(spark, f"{root}/{part}"):
            name = f"{part}/{top.getPath().getName()}"
            inside = [f"{name}/{n}" for n in _names(spark, f"{root}/{name}") if n.startswith(f"{BUCKET}=")]
            if top.getModificationTime() <= last:
                unused = [f for f in inside if f not in used]
                gone += [name] if len(unused) == len(inside) else unused
    for g in gone:
        _deleted(spark, f"{root}/{g}")
    return gone


def overwrite(df: DataFrame, root: str, keep: int = KEEP, keys: Sequence[str] | None = None, bucket_rows: int = BUCKET_ROWS, properties: Mapping[str, str] | None = None, zones: Sequence[str] | None = None, buckets: Sequence[Bucket] | None = None) -> int:
    """A new version with whatever columns df has; returns its number. Raises Conflict if another one came in between.

    zones None: those columns have zones that have them now. buckets: to begin with; those that turn out too large are written again.
    """
    spark = df.sparkSession
    last = version(spark, root)
    old = manifest(spark, root, last) if last is not None else None
    if keys is None:
        keys = [k for k in (old.keys if old else [KEY]) if k in df.columns] or df.columns[:1]
    known = [c for c in old.columns if c[1] in df.columns] if old else []
    try:
        columns = _columns(known, df.schema)
    except ValueError:
        columns = _columns([], df.schema)
    order = {n: i for i, n in enumerate(df.columns)}
    if zones is None:
        zones = [name for _, name, _ in (old.zoned if old else []) if name in df.columns and _has_place(df.schema[name].dataType)]
    m = Manifest((last or 0) + 1, tuple(sorted(columns, key=lambda c: order[c[1]])), tuple(keys), (), bucket_rows, dict(properties or {}), _zone_numbers(columns, zones, df.schema))
    made = _rewritten(spark, root, m, _write(df, root, m, buckets or Bucket(0, 0).split(DEPTH)))
    if not _published(spark, root, replace(m, buckets=tuple(made))):
        for b in made:
            if b.folder:
                _deleted(spark, f"{root}/{b.folder}")
        raise Conflict(f"version {m.number} of {root} was written by someone else")
    _given_up(spark, root, keep)
    return m.number


def _staged(new: DataFrame, root: str) -> tuple[DataFrame, str]:
    """The rows, computed once."""
    path = f"{root}/{STAGED}/{uuid.uuid4().hex}"
    new.write.parquet(path)
    return new.sparkSession.read.schema(new.schema).parquet(path), path


@dataclass(frozen=True)
class Merge:
    """What an upsert puts in the place of some buckets."""

    columns: tuple[tuple[int, str, str], ...]
    before: tuple[Bucket, ...]
    after: tuple[Bucket, ...]


def _fill(rows: DataFrame, schema: T.StructType, keys: Sequence[str], buckets: Sequence[Bucket]) -> dict[int, int]:
    """How many of the rows fall into each bucket, by its number."""
    return {r[BUCKET]: r["count"] for r in rows.select(_number(_hash(schema, keys), buckets).alias(BUCKET)).groupBy(BUCKET).count().collect()}


def _merge(rows: DataFrame, root: str, m: Manifest, how: How | str) -> Merge:
    """Merges stored rows into the buckets of a version that they fall into; how: a merge, or the column that guards one. Writes folders,
    commits nothing."""
    spark = rows.sparkSession
    wide = replace(m, columns=_columns(m.columns, rows.schema))
    new = _aligned(rows, wide.columns)
    counts = _fill(new, wide.schema, m.keys, m.buckets)
    before = [b for b in m.buckets if b.number in counts]
    if not before:
        return Merge(wide.columns, (), ())
    old = _aligned(_read(spark, root, wide, before), wide.columns)
    after = [c for b in before for c in _grown(b, b.rows + counts[b.number], m.bucket_rows)]
    # Rows fall into these buckets only, but their numbers depend on all of the directory.
    untouched = [b for b in m.buckets if b.number not in counts]
    if isinstance(how, str):
        most = max(b.rows + counts[b.number] for b in before)
        made = _saved(_guarded(old, new, wide, after + untouched, how, min(most, m.bucket_rows)), root, wide, after + untouched)
    else:
        made = _write(how(old, new), root, wide, after + untouched)
    return Merge(wide.columns, tuple(before), tuple(b for b in made if b.number in {x.number for x in after}))


#: Old rows and new rows of some buckets to what they are from now on.
How = Callable[[DataFrame, DataFrame], DataFrame]


def _on_top(m: Manifest, base: Manifest, merge: Merge, properties: Mapping[str, str]) -> Manifest | None:
    """The version after m that a merge on base makes; None if m has other buckets or columns where it matters."""
    if m.keys != base.keys or m.columns != base.columns or not set(merge.before) <= set(m.buckets):
        return None
    stay = [b for b in m.buckets if b not in set(merge.before)]
    return replace(m, number=m.number + 1, columns=merge.columns, buckets=tuple(stay) + merge.after, properties={**m.properties, **properties})


def upsert(
    new: DataFrame,
    root: str,
    keys: Sequence[str] = (KEY,),
    guarded: bool = True,
    revision: str = REVISION,
    keep: int = KEEP,
    bucket_rows: int = BUCKET_ROWS,
    properties: Mapping[str, str] | None = None,
    expected: Mapping[str, str | None] | None = None,
    how: How | None = None,
    zones: Sequence[str] | None = None,
) -> int:
    """Merges new, one row a key, into the table, or makes it, with zones; returns the version. guarded: older revisions don't win.

    how replaces the merge by another one, of rows that share no bucket with others. The version gets the properties;
    expected ones must be as given just before, or nothing is written and Conflict is raised.
    """
    spark, properties, expected = new.sparkSession, dict(properties or {}), dict(expected or {})
    how = how or (revision if guarded else lambda old, rows: merged(old, rows, keys))

    def check(m: Manifest) -> Manifest:
        if any(m.properties.get(k) != v for k, v in expected.items()):
            raise Conflict(f"{root} isn't at {expected} any more")
        return m

    rows, staged = _staged(new, root)
    try:
        if not exists(spark, root):
            try:
                # Stored rows are cheap to count; only a bucket whose halves are uneven may have to be written twice.
                few = Bucket(0, 0).split(DEPTH)
                counts = _fill(rows, rows.schema, keys, few)
                return overwrite(rows, root, keep, keys, bucket_rows, properties, zones, [c for b in few for c in _grown(b, counts.get(b.number, 0), bucket_rows)])
            except Conflict:
                pass  # made by someone else meanwhile
        for _ in range(TRIES):
            base = check(manifest(spark, root))
            if base.keys != tuple(keys):
                raise ValueError(f"{root} is kept by {', '.join(base.keys)}, not {', '.join(keys)}")
            merge = _merge(rows, root, base, how)
            while following := _on_top(check(manifest(spark, root)), base, merge, properties):
                if _published(spark, root, following):
                    _given_up(spark, root, keep)
                    return following.number
            for b in merge.after:
                if b.folder:
                    _deleted(spark, f"{root}/{b.folder}")
        raise Conflict(f"{root} was written by others {TRIES} times")
    finally:
        _deleted(spark, staged)


def _altered(spark: SparkSession, root: str, change: Callable[[Manifest], Manifest]) -> int:
    """A version with another manifest and the same folders."""
    for _ in range(TRIES):
        m = manifest(spark, root)
        following = replace(change(m), number=m.number + 1)
        if _published(spark, root, following):
            return following.number
    raise Conflict(f"{root} was written by others {TRIES} times")


def rename(spark: SparkSession, root: str, old: str, new: str) -> int:
    """Gives a column another name, in the manifest alone."""

    def change(m: Manifest) -> Manifest:
        names = [n for _, n, _ in m.columns]
        if old not in names or new in names:
            raise ValueError(f"{old} can't become {new} among {', '.join(names)}")
        other = lambda n: new if n == old else n
        return replace(m, columns=tuple((i, other(n), k) for i, n, k in m.columns), keys=tuple(map(other, m.keys)))

    return _altered(spark, root, change)


def zone(spark: SparkSession, root: str, *columns: str) -> int:
    """These columns have zones from now on, others don't; a folder that is there already gets its ones when it's written anew, and
    is always read until then."""
    return _altered(spark, root, lambda m: replace(m, zones=_zone_numbers(m.columns, columns, m.schema)))


def changes(spark: SparkSession, root: str, since: int | None, until: int | None = None) -> DataFrame:
    """What turned one version into another: its columns and change, which is inserted or deleted, or before and after for the
    two images of an updated row. since None: all rows as inserted.

    Read are the buckets only whose folders differ; rows that are the same in both give nothing.
    """
    now = manifest(spark, root, until)
    if since is None:
        return _read(spark, root, now, now.buckets).withColumn(CHANGE, F.lit(INSERTED))
    then = manifest(spark, root, since)
    same = then.folders & now.folders
    sides = [_aligned(_read(spark, root, replace(m, columns=_renamed(m, now)), [b for b in m.buckets if b.folder not in same]), now.columns) for m in (then, now)]
    row = lambda df, name: df.select(F.struct(*[F.col(f"`{n}`") for _, n, _ in now.columns]).alias(name))
    old, new = row(sides[0], "old"), row(sides[1], "new")
    on = reduce(Column.__and__, [F.col("old")[k].eqNullSafe(F.col("new")[k]) for k in now.keys])
    both = old.join(new, on, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    image = lambda side, change: F.struct(F.col(side).alias("row"), F.lit(change).alias(CHANGE))
    images = F.when(F.col("old").isNull(), F.array(image("new", INSERTED))).when(F.col("new").isNull(), F.array(image("old", DELETED))).otherwise(F.array(image("old", BEFORE), image("new", AFTER)))
    return both.select(F.inline(images)).select("row.*", CHANGE)


def _renamed(m: Manifest, now: Manifest) -> tuple[tuple[int, str, str], ...]:
    """m's columns by the names and types that they have now; without those that are gone."""
    today = {number: (number, name, kind) for number, name, kind in now.columns}
    return tuple(today[number] for number, _, _ in m.columns if number in today)
