"""Versioned tables on plain Parquet: staged folders, published by one small manifest.

Several tables flip together because readers only follow a manifest, which names for each table the folder of
each bucket.  Rows are written to new folders first; publishing creates the next manifest, and creating it fails
where it exists.  So of two writers that started from the same version one loses (``Conflict``), looks at the new
version and decides again.  A writer that dies before publishing leaves no trace that a reader sees.

A table is dealt into buckets by the hash of its bucket column.  A change of some documents rewrites only the buckets
they are in.  Manifests hold tables times buckets rows, whatever the size of the tables.

Rows that break a check of their table keep the whole change from being published: the check runs in the pass that
writes, broken rows land in a folder of their own, which ``Violation`` names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The bucket of tables that are written as a whole.
WHOLE = -1
_FINE = "ok"


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to be."""


class Violation(ValueError):
    """Rows that break a check; they are in ``folder`` and nothing was published."""

    def __init__(self, table: str, broken: Mapping[str, int], folder: str):
        super().__init__(f"{table}: {dict(broken)}, rows in {folder}")
        self.table, self.broken, self.folder = table, dict(broken), folder


class Version(NamedTuple):
    number: int
    folders: Mapping[tuple[str, int], str]
    next_ids: Mapping[str, int]


class Staged(NamedTuple):
    """Folders of the buckets that replace those named in ``touched``, and the id after the largest one."""

    folders: Mapping[int, str]
    touched: frozenset[int]
    next_id: int


@dataclass(frozen=True)
class Stored:
    """A table: columns, what its rows are dealt by, what names a row, and what holds for each row (SQL by name)."""

    schema: str
    bucket: str
    key: tuple[str, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, p = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder; none is fine."""
    fs, p = _file_system(spark, folder)
    fs.delete(p, True)


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Put a whole file at ``path``; False, and no change, where there is one."""
    jvm, (fs, final) = spark.sparkContext._jvm, _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(options, 1)
    never[0] = options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), never)
        return True
    except Exception:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise


@dataclass(frozen=True)
class Store:
    """Tables under ``root``.  ``buckets`` belongs to the store and must not change while it holds rows."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def pin(self) -> Version:
        """The newest version; what is read at it stays as it is."""
        names = [n for n in listed(self.spark, f"{self.root}/_manifests") if re.fullmatch(r"v\d+\.json", n)]
        if not names:
            return Version(0, {}, {})
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/_manifests/{names[-1]}").first()[0]
        held = json.loads(text)
        return Version(held["version"], {(t, b): f for t, b, f in held["folders"]}, held["next_ids"])

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def read(self, table: str, at: Version, stored: Stored | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, at a version; empty where it has no rows."""
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.root}/{f}" for (t, b), f in sorted(at.folders.items()) if t == table and (wanted is None or b in wanted)]
        if not folders:
            if stored is None:
                raise KeyError(table)
            return self.spark.createDataFrame([], stored.schema)
        reader = self.spark.read if stored is None else self.spark.read.schema(stored.schema)
        return reader.parquet(*folders)

    def touched(self, rows: DataFrame, column: str) -> frozenset[int]:
        """Buckets that the values are in, at most as many as there are."""
        return frozenset(r[0] for r in rows.select(self.bucket(column)).distinct().collect())

    def keep(self, df: DataFrame) -> DataFrame:
        """Write to the store's scratch folder and read back: decisions made once stay, also when executors are lost."""
        path = f"{self.root}/_scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage(self, table: str, df: DataFrame, stored: Stored | None = None, touched: Iterable[int] | None = None) -> Staged:
        """Write the rows that replace the touched buckets (None: all), checking them meanwhile."""
        folder = f"{table}/{uuid.uuid4().hex}"
        if stored is None:
            df.write.parquet(f"{self.root}/{folder}")
            return Staged({WHOLE: folder}, frozenset([WHOLE]), 1)
        columns = [c.name for c in self.spark.createDataFrame([], stored.schema).schema]
        broken = F.coalesce(*(F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in stored.checks.items()), F.lit(_FINE))
        rows = df.select(*columns).withColumn("_check", broken).withColumn("_bucket", self.bucket(stored.bucket))
        seen = Observation()
        counted = [F.count(F.when(F.col("_check") == name, 1)).alias(name) for name in stored.checks]
        largest = F.max("id" if "id" in columns else F.lit(0).cast("long"))
        rows = rows.observe(seen, F.coalesce(largest, F.lit(0)).alias("_id"), F.count("*").alias("_rows"), *counted)
        rows.hint("rebalance", "_bucket").write.partitionBy("_check", "_bucket").parquet(f"{self.root}/{folder}")
        # A plan over no rows at all may be optimised away with what observes it.
        some = any(n.startswith("_check=") for n in listed(self.spark, f"{self.root}/{folder}"))
        found = seen.get if some else {"_id": 0, **dict.fromkeys(stored.checks, 0)}
        if bad := {n: found[n] for n in stored.checks if found[n]}:
            raise Violation(table, bad, f"{self.root}/{folder}")
        fine = f"{folder}/_check={_FINE}"
        folders = {int(n.partition("=")[2]): f"{fine}/{n}" for n in listed(self.spark, f"{self.root}/{fine}") if n.startswith("_bucket=")}
        if stored.key and folders:
            own = self.spark.read.schema(stored.schema).parquet(*(f"{self.root}/{f}" for f in folders.values()))
            twice = own.groupBy(*stored.key).count().filter("count > 1").limit(1).count()
            if twice:
                raise Violation(table, {"key": twice}, f"{self.root}/{folder}")
        return Staged(folders, frozenset(range(self.buckets)) if touched is None else frozenset(touched), found["_id"] + 1)

    def stage_all(self, tables: Mapping[str, tuple[DataFrame, Stored | None, Iterable[int] | None]]) -> dict[str, Staged]:
        """``stage`` of several tables at once: their jobs share the cluster instead of waiting for each other."""
        with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
            made = {name: pool.submit(self.stage, name, *args) for name, args in tables.items()}
            return {name: future.result() for name, future in made.items()}

    def commit(self, base: Version, changes: Mapping[str, Staged]) -> Version:
        """Publish staged folders as the version after ``base``; tables and buckets not named keep theirs."""
        folders, next_ids = dict(base.folders), dict(base.next_ids)
        for table, staged in changes.items():
            for b in [b for t, b in folders if t == table and (b in staged.touched or b == WHOLE)]:
                del folders[table, b]
            folders.update({(table, b): f for b, f in staged.folders.items()})
            next_ids[table] = max(next_ids.get(table, 1), staged.next_id)
        made = Version(base.number + 1, folders, next_ids)
        text = json.dumps({"version": made.number, "folders": [[t, b, f] for (t, b), f in sorted(folders.items())], "next_ids": next_ids})
        if not create_if_absent(self.spark, f"{self.root}/_manifests/v{made.number:012d}.json", text):
            raise Conflict(f"version {made.number} of {self.root} is taken")
        return made

    def publish(self, tables: Mapping[str, DataFrame], stored: Mapping[str, Stored] | None = None) -> Version:
        """Whole tables as the next version."""
        base = self.pin()
        return self.commit(base, self.stage_all({name: (df, (stored or {}).get(name), None) for name, df in tables.items()}))


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Write whole tables, without checks, as the next version; tables not named keep their folders."""
    return Store(spark, root).publish(tables).number


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """table -> folder of the newest version, of tables that were written whole."""
    return {t: f for (t, b), f in Store(spark, root).pin().folders.items() if b == WHOLE}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    store = Store(spark, root)
    return store.read(table, store.pin())
