"""Versioned Parquet tables.

A database is a folder: ``manifest.json`` says which data files make up each table, and is replaced
as a whole, so a commit happens entirely or not at all. Writers of all processes take turns by a
lock file and build on the newest manifest. On a store whose rename is no single step, a reader may see
no manifest for a moment; the lock holds there too if files can be made only where there is none. Data files are never changed; a version is
a list of them. A reader keeps the list it began with, so later commits do not disturb it.

A statement's changes are a *delta*: rows keyed by primary key, with a mark on deleted ones. To
commit, only files that hold a changed key are written anew; the others are carried over. Files
are sorted by primary key and have statistics and, for indexed columns, Bloom filters, by which
scans skip row groups. Indexes are nothing but these hints: results never depend on them."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Busy
from .catalog import Catalog, Entry
from .files import Files
from .tables import Table, physical_schema

MANIFEST, LOCK = "manifest.json", "manifest.lock"
#: Seconds that a writer waits for another, and after which a claim counts as left behind.
LOCK_WAIT, LOCK_LIFE = 300, 1800
DELETED = "deleted"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.files.make("data")
        self.catalog, self.held = Catalog(), 0
        self.refresh()

    def refresh(self) -> Catalog:
        """The newest version, which another database on the folder may have published."""
        if self.files.exists(MANIFEST):
            self.catalog = Catalog.loaded(self.files.read(MANIFEST))
        return self.catalog

    @contextlib.contextmanager
    def exclusive(self) -> Iterator[None]:
        """One writer at a time, in whatever process: what is published inside follows the newest version.
        A claim that outlives its writer is broken after LOCK_LIFE seconds."""
        if not self.held:
            end = time.monotonic() + LOCK_WAIT
            while not self.files.claim(LOCK):
                if self.files.age(LOCK) > LOCK_LIFE:
                    self.files.drop(LOCK)
                elif time.monotonic() > end:
                    raise Busy(self.files.root)
                else:
                    time.sleep(0.02)
            self.refresh()
        self.held += 1
        try:
            yield
        finally:
            self.held -= 1
            if not self.held:
                self.files.drop(LOCK)

    def publish(self, catalog: Catalog) -> None:
        """Inside `exclusive`: the next version, built on the one that was read there."""
        if self.files.exists(MANIFEST) and Catalog.loaded(self.files.read(MANIFEST)).version != self.catalog.version:
            raise Busy(self.files.root)  # this writer's claim was broken meanwhile
        catalog = replace(catalog, version=self.catalog.version + 1)
        self.files.replace(MANIFEST, catalog.dumped())
        self.catalog = catalog

    # -- reading ----------------------------------------------------------------------------

    def rows(self, entry: Entry, files: tuple[str, ...] | None = None) -> DataFrame:
        files, schema = entry.files if files is None else files, physical_schema(entry.columns)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/data/{f}" for f in files))

    def table(self, entry: Entry, delta: DataFrame | None = None) -> Table:
        return Table(entry.name, entry.columns, overlay(self.rows(entry), delta, entry))

    # -- writing ----------------------------------------------------------------------------

    def write(self, df: DataFrame, entry: Entry) -> tuple[str, ...]:
        """Data files with the rows of df, sorted by primary key."""
        folder = f"{entry.name.encode().hex()[:40]}-{uuid.uuid4().hex}"
        out = df.sortWithinPartitions(entry.key.physical).write
        for c in {i.column for i in entry.indexes} | {entry.key.name}:
            out = out.option(f"parquet.bloom.filter.enabled#{entry.column(c).physical}", "true")
        out.parquet(f"{self.files.root}/data/{folder}")
        return tuple(f"{folder}/{f}" for f in self.files.listed(f"data/{folder}") if f.endswith(".parquet"))

    def scratch(self, delta: DataFrame, entry: Entry) -> tuple[DataFrame, str]:
        """delta as a table of its own: nothing is worked out twice."""
        folder = f"delta-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.files.root}/data/{folder}")
        return self.spark.read.schema(delta_schema(entry)).parquet(f"{self.files.root}/data/{folder}"), folder

    def merged(self, entry: Entry, delta: DataFrame) -> Entry:
        """The next version of a table: delta's rows win by primary key."""
        key, live = entry.key.physical, delta.filter(~F.col(DELETED)).drop(DELETED)
        touched: set[str] = set()
        if entry.files:
            bounds = delta.agg(F.min(key), F.max(key)).first()
            old = self.rows(entry).filter(F.col(key).between(*(F.lit(b) for b in bounds)))  # skips files by statistics
            named = old.select(key, F.input_file_name().alias("file")).join(delta.select(key), key, "left_semi")
            touched = {"/".join(r[0].split("/")[-2:]) for r in named.select("file").distinct().collect()}  # one value a file
        kept = tuple(f for f in entry.files if f not in touched)
        rows = live
        if touched:
            rows = self.rows(entry, tuple(f for f in entry.files if f in touched)).join(delta.select(key), key, "left_anti").unionByName(live)
        return replace(entry, files=(*kept, *self.write(rows, entry)))

    def files_of(self, rows: DataFrame) -> set[str]:
        """The data files that hold rows, which come from a scan: one value a file reaches the driver."""
        found = rows.select(F.input_file_name().alias("file")).distinct().collect()
        return {"/".join(r[0].split("/")[-2:]) for r in found}

    def indexed(self, entry: Entry) -> Entry:
        """The same rows in files that have the Bloom filters of all indexes."""
        return replace(entry, files=self.write(self.rows(entry), entry)) if entry.files else entry

    def compacted(self, entry: Entry) -> Entry:
        """The same rows in fewer files, in ranges of the primary key, so that scans skip most of them."""
        if len(entry.files) < 2:
            return entry
        return replace(entry, files=self.write(self.rows(entry).repartitionByRange(entry.key.physical), entry))

    def vacuum(self) -> int:
        """Deletes data that the current version does not name; no reader may be open."""
        used = {f.split("/")[0] for t in self.catalog.all() for f in t.files}
        idle = [f for f in self.files.listed("data") if f not in used]
        for f in idle:
            self.files.drop(f"data/{f}")
        return len(idle)


def delta_schema(entry: Entry) -> T.StructType:
    return T.StructType([*physical_schema(entry.columns).fields, T.StructField(DELETED, T.BooleanType(), True)])


def overlay(base: DataFrame, delta: DataFrame | None, entry: Entry) -> DataFrame:
    if delta is None:
        return base
    key = entry.key.physical
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta.filter(~F.col(DELETED)).drop(DELETED))


def combined(older: DataFrame | None, newer: DataFrame, entry: Entry) -> DataFrame:
    if older is None:
        return newer
    key = entry.key.physical
    return older.join(newer.select(key), key, "left_anti").select(*newer.columns).unionByName(newer)
