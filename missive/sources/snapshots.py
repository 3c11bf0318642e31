"""Tables that change together: a commit log over folders of Parquet.

A writer puts all files of a commit into folders of its version, ``<table>/v=<version>``, and then makes them
visible at once with one small file, ``_commits/<version>.json``, which is renamed into place and never
overwritten.  A reader opens the newest commit, or one that it names, and sees all of that and nothing
of what came later or was left half done.

A table is of one of three kinds, by how it was first written:

* ``append``: each commit adds rows.
* ``runs``: rows are added too, for look-ups by one column: each run is sorted by it and has Parquet's Bloom filters on it.  A
  commit takes the latest runs that are not over twice as large into its own, so runs shrink by half at least and there are
  as many as the table's size has binary digits.
* keyed: rows lie in a fixed number of buckets by a hash of some columns.  A change rewrites the buckets that its keys
  fall into; the commit says of each bucket in which version it lies, so others are neither read nor
  written.  A table should have so many buckets that one is a few files.

There is one writer at a time, as a stream has one driver; of two the second to publish fails.  ``begin`` clears what
a writer that stopped left in folders of the next version.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes of up to this many rows are sent to all executors, so that a keyed table is not shuffled.
SMALL = 200_000
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer published a commit of the same version."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self.place = jvm.Path
        self.fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files = jvm.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.place(f"{self.path}/{folder}" if folder else self.path)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_commits") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """What a commit says: ``version``, ``tables`` and ``notes``; that of the newest if none is named."""
        known = self.versions()
        version = (known[-1] if known else -1) if version is None else version
        if version < 0:
            return {"version": -1, "tables": {}, "notes": {}}
        if version not in known:
            raise LookupError(f"there is no commit {version}")
        lines = self.spark.read.text(f"{self.path}/_commits/{version:020d}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a commit; of a keyed one only some ``buckets`` if asked for."""
        said = self.manifest(version)
        return self._open(table, said["tables"].get(table), said["version"], buckets)

    def _open(self, table: str, entry: dict | None, version: int, buckets: list[int] | None = None) -> DataFrame:
        if entry is None:
            raise LookupError(f"there is no table {table}")
        reader = self.spark.read.schema(entry["schema"])
        root = f"{self.path}/{table}"
        if entry["kind"] == "append":
            rows = reader.option("basePath", root).format(entry["format"]).load(root)
            return rows.where(F.col("v") <= version)
        if entry["kind"] == "runs":
            return reader.parquet(*(f"{root}/v={v}" for v, _ in entry["runs"]))
        wanted = range(len(entry["at"])) if buckets is None else buckets
        paths = [f"{root}/v={entry['at'][b]}/{BUCKET}={b}" for b in wanted if entry["at"][b] >= 0]
        if not paths:
            return self.spark.createDataFrame([], entry["schema"])
        return reader.parquet(*paths)

    def begin(self) -> Commit:
        """A commit to fill and publish."""
        said = self.manifest()
        version = said["version"] + 1
        for table in self._names(""):
            if not table.startswith(("_commits", ".")):
                self.fs.delete(self.place(f"{self.path}/{table}/v={version}"), True)
        return Commit(self, said, version)


class Commit:
    """Changes that become visible together when they are published."""

    def __init__(self, store: Snapshots, base: dict[str, Any], version: int):
        self.store, self.version = store, version
        self.tables, self.notes = dict(base["tables"]), dict(base["notes"])
        self.changed: set[str] = set()

    def folder(self, table: str) -> str:
        return f"{self.store.path}/{table}/v={self.version}"

    def append(self, table: str, rows: DataFrame, kind: str = "parquet") -> None:
        """Add rows to an append table; a second call in the same commit adds more."""
        entry = self.tables.get(table)
        if entry and entry["kind"] != "append":
            raise ValueError(f"{table} is keyed")
        rows.write.mode("append").format(kind).save(self.folder(table))
        schema = f"{ddl(rows)}, v int"
        self.tables[table] = {"kind": "append", "format": kind, "schema": schema}

    def add_run(self, table: str, rows: DataFrame, key: str) -> None:
        """Add rows to a table of runs, looked up by ``key``."""
        entry = self.tables.get(table) or {"kind": "runs", "schema": ddl(rows), "runs": []}
        new = self.staged(f"{table}-run", rows)
        runs, total = list(entry["runs"]), new.count()
        if not total:
            return
        taken = []
        while runs and runs[-1][1] <= 2 * total:
            taken.append(runs.pop())
            total += taken[-1][1]
        whole = new
        if taken:
            whole = new.unionByName(self.store._open(table, entry | {"runs": taken}, self.version))
        write = whole.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
        write.parquet(self.folder(table))
        self.tables[table] = entry | {"runs": [*runs, [self.version, total]]}

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written for use within this commit."""
        path = f"{self.folder('_staged')}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def current(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A keyed table as this commit has it so far."""
        return self.store._open(table, self.tables.get(table), self.version, buckets)

    def create(self, table: str, rows: DataFrame, by: tuple[str, ...], buckets: int = 64) -> None:
        """A keyed table of ``rows``, in buckets by the SQL expressions ``by``, in place of any of that name.  Near keys that
        change together, such as the uids of a folder, should share a bucket: ``uid div 1000`` rather than ``uid``."""
        self.tables[table] = {"kind": "keyed", "schema": ddl(rows), "by": list(by), "at": [-1] * buckets}
        self._put(table, rows, list(range(buckets)), rows.columns)

    def bucket_of(self, table: str) -> Column:
        entry = self.tables[table]
        return F.pmod(F.xxhash64(*(F.expr(e) for e in entry["by"])), F.lit(len(entry["at"]))).cast("int")

    def _put(self, table: str, rows: DataFrame, buckets: list[int], columns: list[str]) -> None:
        """Write ``rows`` as all that the ``buckets`` hold."""
        entry = self.tables[table]
        dealt = rows.select(*columns).withColumn(BUCKET, self.bucket_of(table))
        # A bucket that was read is in few tasks already; new rows are few.  Only a new table is dealt out.
        if len(buckets) == len(entry["at"]) and max(entry["at"]) < 0:
            dealt = dealt.repartition(BUCKET)
        if table in self.changed:  # a second change would overwrite what it reads
            raise ValueError(f"{table} changes twice in one commit")
        self.changed.add(table)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(self.folder(table))
        filled = {int(n.partition("=")[2]) for n in self.store._names(f"{table}/v={self.version}") if n.startswith(f"{BUCKET}=")}
        at = list(entry["at"])
        for b in buckets:
            at[b] = self.version if b in filled else -1
        self.tables[table] = self.tables[table] | {"at": at}

    def merge(
        self, table: str, changes: DataFrame, keys: tuple[str, ...], supplied: tuple[str, ...] | None = None, defaults: dict | None = None,
        insert: bool = True, nulls: tuple[str, ...] | None = None, ids: tuple[str, tuple[str, ...]] | None = None,
    ) -> list[int]:
        """Apply ``changes`` (with ``seq``; of rows that repeat a key the largest counts) to a keyed table; the buckets that were
        read and written are returned.

        Known rows take the ``supplied`` columns (all that the changes have, if not said).  Where ``nulls`` is given, null
        values change nothing but in these columns.  New rows are inserted, with ``defaults`` for what is null
        or absent, unless ``insert`` is false; ``ids`` names a column that numbers them on from the largest so far, in the
        order of some columns."""
        from missive.operators.store import latest

        entry, spark = self.tables[table], self.store.spark
        types = dict(parse(spark, entry["schema"]))
        new = latest(changes, keys).drop("seq")
        new = new.select(*(F.col(c).cast(types[c]).alias(c) for c in new.columns))
        new = self.staged(f"{table}-changes", new.withColumn(BUCKET, self.bucket_of(table)))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # a row a bucket at most
        if not touched:
            return []
        small = new.count() <= SMALL
        near = F.broadcast if small else (lambda df: df)
        given = [c for c in (supplied if supplied is not None else new.columns) if c in new.columns and c not in keys and c != BUCKET]
        old = self.current(table, touched)
        other = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns if c != BUCKET), F.lit(True).alias("_new"))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys))
        both = old.join(near(other), same, "left")

        def value(c: str) -> Column:
            if c not in given:
                return F.col(c)
            told = F.col(f"_n_{c}")
            told = told if nulls is None or c in nulls else F.coalesce(told, F.col(c))
            return F.when(F.col("_new"), told).otherwise(F.col(c)).alias(c)

        out = both.select(*map(value, types))
        if insert:
            known = old.select(*keys).join(near(other), same, "left_semi")
            known = known.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.lit(True).alias("_known"))
            absent = new.join(near(self.staged(f"{table}-known", known)), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)), "left_anti")
            filled = {c: F.coalesce(F.col(c) if c in new.columns else F.lit(None), F.lit((defaults or {}).get(c))).cast(types[c]) for c in types}
            absent = absent.select(*(v.alias(c) for c, v in filled.items()))
            if ids:
                absent = self._numbered(table, absent, *ids)
            out = out.unionByName(absent)
        self._put(table, out, touched, list(types))
        return touched

    def _numbered(self, table: str, rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
        """New rows with ids on from the largest that the table's commits have given."""
        from missive.operators.store import numbered

        entry = self.tables[table]
        last = entry.get("last")
        if last is None:  # the first time the whole column is looked at
            last = self.current(table).agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
        rows = self.staged(f"{table}-new", rows.withColumn(column, F.lit(None).cast("long")))
        self.tables[table] = entry | {"last": last + rows.count()}
        return numbered(rows, order, last).select(*rows.columns)

    def remove(self, table: str, gone: DataFrame, keys: tuple[str, ...]) -> list[int]:
        """Remove the rows whose keys ``gone`` names."""
        rows = self.staged(f"{table}-gone", gone.select(*keys).distinct().withColumn(BUCKET, self.bucket_of(table)))
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        if touched:
            named = rows.select(*(F.col(k).alias(f"_g_{k}") for k in keys))
            same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys))
            old = self.current(table, touched)
            out = old.join(F.broadcast(named) if rows.count() <= SMALL else named, same, "left_anti")
            self._put(table, out, touched, old.columns)
        return touched

    def note(self, name: str, value: Any) -> None:
        """Something small that is true as of this commit, such as a stream's epoch."""
        self.notes[name] = value

    def publish(self) -> int:
        """Make all of it visible; an error if another writer was first."""
        store = self.store
        text = json.dumps({"version": self.version, "tables": self.tables, "notes": self.notes})
        folder = f"{store.path}/_commits"
        done, part = store.place(f"{folder}/{self.version:020d}.json"), store.place(f"{folder}/_{self.version:020d}")
        if store.fs.exists(done):
            raise Conflict(f"there is a commit {self.version}")
        out = store.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = store.spark._sc._gateway.new_array(store.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            store.files.rename(part, done, options)
        except Exception as e:
            raise Conflict(f"there is a commit {self.version}") from e
        store.fs.delete(store.place(self.folder("_staged")), True)
        return self.version


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def parse(spark: SparkSession, schema: str) -> list[tuple[str, str]]:
    """Names and types of a schema text."""
    return spark.createDataFrame([], schema).dtypes


def vacuum(store: Snapshots, keep: int = 10) -> int:
    """Delete what no commit but the last ``keep`` shows: their files, and buckets that only older ones have.  The number
    of folders that went."""
    versions = store.versions()
    kept = [store.manifest(v) for v in versions[-keep:]]
    gone = 0
    keyed = {t for m in kept for t, e in m["tables"].items() if e["kind"] == "keyed"}
    for table in keyed:
        live = {(v, b) for m in kept for b, v in enumerate(m["tables"].get(table, {"at": []})["at"])}
        for folder in store._names(table):
            v = int(folder.partition("=")[2])
            for part in store._names(f"{table}/{folder}"):
                if part.startswith(f"{BUCKET}=") and v <= versions[-1] and (v, int(part.partition("=")[2])) not in live:
                    gone += store.fs.delete(store.place(f"{store.path}/{table}/{folder}/{part}"), True)
    parts = [("runs", "runs", lambda t: [t]), ("segments", "segments", lambda t: ["contents", "postings", "gone"])]
    for kind, field, folders in parts:
        for table in {t for m in kept for t, e in m["tables"].items() if e["kind"] == kind}:
            held = {r[0] if kind == "runs" else r["v"] for m in kept for r in m["tables"].get(table, {field: []})[field]}
            for folder in folders(table):
                for name in store._names(folder):
                    if (v := int(name.partition("=")[2])) <= versions[-1] and v not in held:
                        gone += store.fs.delete(store.place(f"{store.path}/{folder}/{name}"), True)
    for v in versions[:-keep]:
        store.fs.delete(store.place(f"{store.path}/_commits/{v:020d}.json"), False)
    return gone
