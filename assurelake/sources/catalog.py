"""Tables on plain Parquet: reading, writing, keyed merges, and commits of several tables at once.

A table is a list of parts, folders of Parquet files; a part of a table with buckets holds the rows of one
bucket, which a hash of the key decides. What a table consists of is a small file, and a commit is a smaller one
that names the current file of each table. So

* a commit publishes all tables that a transaction wrote, or none of them;
* readers see the tables as they were before or after it, never a mixture, and a merge may read what it replaces;
* an append writes its own rows only, and a merge by key rewrites the buckets that its keys fall into;
* of two transactions that wrote or read the same table, the later one fails with Conflict; those on
  different tables both go through.

The commit's file gets its name by a rename that fails if the name is taken, as it does on HDFS.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Where that is
    unset on one machine, as in tests, a temporary folder is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/assurelake-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in the shared folder inside the block go at its end. What is to outlast it - a
    query's result - is written elsewhere, or collected, inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def noted(path: str) -> str:
    """The path, which the innermost scope (if there is one) now owns."""
    if _scopes:
        _scopes[-1].append(path)
    return path


#: Spark's setting to remove a plan's shuffle files when it has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Plans that run here leave no shuffle files. For plans that aren't run again: else the files stay until the
    driver collects its garbage, which one with a large heap may not do before the disks are full."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, for plans that read it several times: what is behind it runs
    once, and a lost executor costs no more than a read. A stronger compression also gives a reading task more rows."""
    path = noted(f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    with shuffles_go(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_by_key(existing: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """Rows of `existing` whose key `new` doesn't have, and all of `new`; a matched row keeps the columns
    `keep` of the old one. Keys are unique in both, as upserts require; nulls match nulls."""
    on = [existing[k].eqNullSafe(new[k]) for k in key]
    gone = existing.join(new.select(*key), on, "left_anti").select(*existing.columns)
    kept = [c for c in keep if c in existing.columns and c not in key]
    if not kept:  # nothing of an old row stays
        return gone.unionByName(new.select(*[(F.col(c) if c in new.columns else F.lit(None).cast(existing.schema[c].dataType)).alias(c) for c in existing.columns]))
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in kept])
    matched = new.join(old, [new[k].eqNullSafe(old[f"_{k}"]) for k in key], "left")
    # a new table may lack a generated column: then it has only the old row's
    columns = [
        (F.coalesce(f"_{c}", new[c]) if c in new.columns else F.col(f"_{c}")).alias(c) if c in kept else (new[c] if c in new.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c))
        for c in existing.columns
    ]
    return gone.unionByName(matched.select(*columns))


def merge_dealt(existing: DataFrame, new: DataFrame, key: list[str], by: dict[str, Column], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """merge_by_key() with all rows moved once: rows of a key meet where `by`, made of the key, puts them, and stay there."""
    kept = [c for c in keep if c in existing.columns and c not in key]
    values = [F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns]
    rows = existing.withColumn("_new", F.lit(False)).unionByName(new.select(*values, F.lit(True).alias("_new")))
    of_key = Window.partitionBy(*by, *[f"`{k}`" for k in key])
    last, first = of_key.orderBy(F.desc("_new")), of_key.orderBy("_new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(by).repartition(*by)
    rows = rows.withColumns({f"_{i}_old": F.first(f"`{c}`", ignorenulls=True).over(first) for i, c in enumerate(kept)})  # the old row's, unless that has none
    rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return rows.select(*[F.col(f"_{kept.index(c)}_old").alias(c) if c in kept else F.col(f"`{c}`") for c in existing.columns])


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't there yet, the first of equals by all columns: what an INSERT with
    ON CONFLICT DO NOTHING adds."""
    first = new.groupBy(*key).agg(F.min(F.struct(*[c for c in new.columns if c not in key])).alias("_v"))
    fresh = first.join(existing.select(*key), [first[k].eqNullSafe(existing[k]) for k in key], "left_anti")
    return fresh.select(*[F.col(c) if c in key else F.col(f"_v.{c}").alias(c) for c in new.columns])


def replace_tagged(existing: DataFrame, new: DataFrame, tag: str, value: str) -> DataFrame:
    """existing without the rows tagged `value`, and new: a delete by tag followed by an insert."""
    return existing.filter(~F.col(tag).eqNullSafe(F.lit(value))).unionByName(new)


class Conflict(ValueError):
    """Another transaction has changed a table that this one read or wrote."""


@dataclass(frozen=True)
class Table:
    """What a table consists of. parts: folder -> its bucket (None without buckets); notes: what its writers want
    to be published with it."""

    schema: str
    key: tuple[str, ...] = ()
    buckets: int = 0
    parts: dict[str, int | None] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"schema": json.loads(self.schema), "key": self.key, "buckets": self.buckets, "parts": self.parts, "notes": self.notes})

    @staticmethod
    def of(text: str) -> Table:
        x = json.loads(text)
        return Table(json.dumps(x["schema"]), tuple(x["key"]), x["buckets"], x["parts"], x["notes"])

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


#: Commits whose tables can still be read; what only older ones had is removed.
KEPT = 8
_BUCKET = "_bucket"


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    """The bucket of a row. Keys are compared as texts, so that their type doesn't matter."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


#: Places in which the rows of a bucket may be while a plan runs.
SHARES = 8


def dealt_by(key: tuple[str, ...] | list[str], buckets: int) -> dict[str, Column]:
    """Columns by which rows are dealt so that a task has few buckets: rows that meet by them, and lie so when they are
    written, needn't be moved again for that."""
    share = F.pmod(F.xxhash64(F.lit("share"), *[F.col(f"`{k}`").cast("string") for k in key]), F.lit(SHARES)).cast("int")
    return {"_dealt": bucket_of(tuple(key), buckets), "_share": share}


class Catalog:
    """Named tables in a folder. Changes outside of a transaction are one of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _store(self, path: str, text: str) -> None:
        p, fs = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _drop(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def commits(self) -> list[int]:
        """Numbers of the commits, the oldest first."""
        return [int(n.split(".")[0]) for n in self._listed(f"{self.root}/_commits") if n.endswith(".json")]

    def tables(self, commit: int | None = None) -> dict[str, str]:
        """The current file of each table, as of a commit (the newest)."""
        found = self.commits()
        if commit is None and not found:
            return {}
        return json.loads(self._load(f"{self.root}/_commits/{found[-1] if commit is None else commit:012d}.json"))

    def table(self, name: str, commit: int | None = None) -> Table | None:
        at = self.tables(commit).get(name)
        return Table.of(self._load(f"{self.root}/{name}/tables/{at}")) if at else None

    def exists(self, name: str) -> bool:
        return name in self.tables()

    def rows(self, name: str, table: Table, parts: list[str] | None = None) -> DataFrame:
        """The rows of some parts (all) of a table."""
        chosen = sorted(table.parts) if parts is None else parts
        if not chosen:
            return self.spark.createDataFrame([], table.struct())
        return self.spark.read.schema(table.struct()).parquet(*[f"{self.root}/{name}/parts/{x}" for x in chosen])

    def read(self, name: str, commit: int | None = None) -> DataFrame:
        found = self.table(name, commit)
        if not found:
            raise KeyError(f"no table {name}")
        return self.rows(name, found)

    def lookup(self, name: str, keys: DataFrame, table: Table | None = None) -> DataFrame:
        """The rows whose key is among `keys` (columns of the table's key): only their buckets are read."""
        found = table or self.table(name)
        if not found or not found.buckets:
            raise KeyError(f"no table {name} with buckets")
        wanted = {r[0] for r in keys.select(bucket_of(found.key, found.buckets)).distinct().collect()}  # a number a bucket
        rows = self.rows(name, found, sorted(p for p, b in found.parts.items() if b in wanted))
        return rows.join(keys.select(*found.key).distinct(), list(found.key), "left_semi").select(*rows.columns)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """Rows that came (_change 1) and went (-1) between two commits; only parts that differ are read. A row
        that a merge rewrote as it was is there with both."""
        new = self.table(name, until)
        old = self.table(name, since)
        if not new:
            raise KeyError(f"no table {name}")
        came = self.rows(name, new, sorted(set(new.parts) - set(old.parts if old else ()))).withColumn("_change", F.lit(1))
        if not old:
            return came
        return came.unionByName(self.rows(name, old, sorted(set(old.parts) - set(new.parts))).withColumn("_change", F.lit(-1)))

    def transaction(self) -> Transaction:
        return Transaction(self)

    def write(self, name: str, df: DataFrame, key: list[str] | None = None, buckets: int = 0) -> None:
        """Replace the table; with a key and a number of buckets, one whose merges rewrite few of them."""
        with self.transaction() as t:
            t.write(name, df, key, buckets)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows with the table's columns."""
        with self.transaction() as t:
            t.append(name, df)

    def merge(self, name: str, df: DataFrame, key: list[str]) -> None:
        with self.transaction() as t:
            t.merge(name, df, key)

    def _tidy(self) -> None:
        """Remove what only commits before the last KEPT ones had."""
        found = self.commits()
        old, kept = found[:-KEPT], found[-KEPT:]
        if not old:
            return
        live = [self.tables(c) for c in kept]
        for c in old:
            for name, file in self.tables(c).items():
                if any(t.get(name) == file for t in live):
                    continue
                path = f"{self.root}/{name}/tables/{file}"
                p, fs = self._fs(path)
                if fs.exists(p):
                    used = {x for f in {t[name] for t in live if name in t} for x in Table.of(self._load(f"{self.root}/{name}/tables/{f}")).parts}
                    for part in set(Table.of(self._load(path)).parts) - used:
                        self._drop(f"{self.root}/{name}/parts/{part}")
                    self._drop(path)
            self._drop(f"{self.root}/_commits/{c:012d}.json")


class Transaction:
    """Changes of several tables that are published together at the end of a `with` block, or not at all if it
    fails. Reads see the tables as they were when it began, with its own changes."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        found = catalog.commits()
        self.base = found[-1] if found else -1
        self.tables = catalog.tables(self.base) if found else {}
        self.changed: dict[str, Table] = {}
        self.seen: set[str] = set()
        self.written: list[str] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()

    def table(self, name: str) -> Table | None:
        self.seen.add(name)
        if name in self.changed:
            return self.changed[name]
        return Table.of(self.catalog._load(f"{self.catalog.root}/{name}/tables/{self.tables[name]}")) if name in self.tables else None

    def exists(self, name: str) -> bool:
        return self.table(name) is not None

    def read(self, name: str) -> DataFrame:
        found = self.table(name)
        if not found:
            raise KeyError(f"no table {name}")
        return self.catalog.rows(name, found)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        return self.catalog.lookup(name, keys, self.table(name))

    def _parts(self, name: str, df: DataFrame, table: Table, dealt: bool = False) -> dict[str, int | None]:
        """Write rows as parts of their own; those of a table with buckets by bucket, and as they lie if they are dealt_by()
        its key."""
        part = uuid.uuid4().hex
        path = f"{self.catalog.root}/{name}/parts/{part}"
        self.written.append(path)
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.struct()])
        if not table.buckets:
            with shuffles_go(self.catalog.spark):
                df.write.parquet(path)
            return {part: None}
        df = df.withColumn(_BUCKET, bucket_of(table.key, table.buckets))
        # large buckets are split over tasks, small ones share one
        with shuffles_go(self.catalog.spark):
            (df if dealt else df.hint("rebalance", _BUCKET)).write.option("compression", "zstd").partitionBy(_BUCKET).parquet(path)
        return {f"{part}/{n}": int(n.split("=")[1]) for n in self.catalog._listed(path) if n.startswith(f"{_BUCKET}=")}

    def write(self, name: str, df: DataFrame, key: list[str] | None = None, buckets: int = 0, notes: dict[str, str] | None = None, dealt: bool = False) -> None:
        """Replace the table. Without a key it keeps the key and the buckets that it has. `dealt`: the rows lie by dealt_by()
        of its key already."""
        old = self.table(name)
        schema = re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', df.schema.json())  # later rows may have nulls
        new = Table(schema, tuple(key), buckets) if key and buckets else Table(schema, old.key, old.buckets) if old else Table(schema)
        new = replace(new, notes=notes if notes is not None else old.notes if old else {})
        self.changed[name] = replace(new, parts=self._parts(name, df, new, dealt))

    def append(self, name: str, df: DataFrame) -> None:
        old = self.table(name)
        if not old:
            return self.write(name, df)
        self.changed[name] = replace(old, parts=old.parts | self._parts(name, df, old))

    def merge(self, name: str, df: DataFrame, key: list[str], keep: tuple[str, ...] = ("id", "created_at"), notes: dict[str, str] | None = None) -> None:
        """Rows of df replace those with their key and are added to the rest. A table with buckets by this key is
        rewritten in the buckets that the keys of df fall into."""
        old = self.table(name)
        if not old:
            return self.write(name, df)
        if not old.buckets or old.key != tuple(key):
            return self.write(name, merge_by_key(self.catalog.rows(name, old), df, key, keep), notes=notes)
        touched = {r[0] for r in df.select(bucket_of(old.key, old.buckets)).distinct().collect()}  # a number a bucket
        stale = sorted(p for p, b in old.parts.items() if b in touched)
        rows = merge_dealt(self.catalog.rows(name, old, stale), df, key, dealt_by(key, old.buckets), keep)
        new = self._parts(name, rows, old, dealt=True)
        self.changed[name] = replace(old, parts={p: b for p, b in old.parts.items() if b not in touched} | new, notes=old.notes if notes is None else notes)

    def abort(self) -> None:
        for path in self.written:
            self.catalog._drop(path)
        self.written, self.changed = [], {}

    def commit(self) -> None:
        """Publish. Commits of others since the beginning are no conflict unless they changed what was read here."""
        if not self.changed:
            return
        c, files = self.catalog, {}
        for name, table in self.changed.items():
            files[name] = f"{uuid.uuid4().hex}.json"
            c._store(f"{c.root}/{name}/tables/{files[name]}", table.text())
        draft = f"{c.root}/_commits/.{uuid.uuid4().hex}"
        while True:
            found = c.commits()
            now = c.tables(found[-1]) if found else {}
            if any(now.get(n) != self.tables.get(n) for n in self.seen):
                for name, file in files.items():
                    c._drop(f"{c.root}/{name}/tables/{file}")
                self.abort()
                raise Conflict(f"changed meanwhile: {', '.join(sorted(n for n in self.seen if now.get(n) != self.tables.get(n)))}")
            c._store(draft, json.dumps(now | files))
            p, fs = c._fs(f"{c.root}/_commits/{found[-1] + 1 if found else 0:012d}.json")
            source, _ = c._fs(draft)
            if not fs.exists(p) and fs.rename(source, p):
                break
            c._drop(draft)  # another was first: look again
        self.written, self.changed = [], {}
        c._tidy()
