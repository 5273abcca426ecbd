"""Tables that change whole: new data are written beside the old, and one manifest that names every table's parts is what readers follow.

A manifest is a small JSON file with a number. A commit writes the next number and fails if it is there already, so of two writers one must
start again, and readers see all of a version or all of the one before, whatever tables it touched. Data of a failed run are named by
no manifest. A table may be split in buckets by a key, each with a path of its own; what a commit doesn't name keeps its files as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickforge.sources.shared import drop_table, written

#: Buckets of a table that is replaced by key.
BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """The tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the newest manifest; 0 before the first."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}}
        rows = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest by default."""
        found = self.manifest(version)["tables"][name]
        return self._parts(found["schema"], list(found["parts"].values()))

    def _parts(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _schema(schema))
        return self.spark.read.schema(_schema(schema)).parquet(*sorted({f"{self.path}/{p}" for p in paths}))

    def _written(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, base: int, changes: dict[str, dict], facts: dict | None = None) -> int:
        """The manifest after `base` with the changed tables; Conflict if there is one already."""
        tables = self.manifest(base)["tables"] | changes
        text = json.dumps({"tables": tables, "facts": facts or {}}, sort_keys=True)
        made, target = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{base + 1:012d}.json")
        out = self._fs.create(made, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, target, none)
        except Exception as refused:
            self._fs.delete(made, False)
            if self._fs.exists(target):
                raise Conflict(f"version {base + 1} of {self.path} was committed by another run") from refused
            raise
        return base + 1

    def publish(self, tables: dict[str, DataFrame], facts: dict | None = None) -> int:
        """Each table whole, all in one version."""
        base = self.version()
        return self._commit(base, {name: {"schema": _ddl(df), "parts": {"all": self._written(df)}} for name, df in tables.items()}, facts)

    def upsert(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> int:
        """Rows by key, (rows, key columns) for each table: a key's new row replaces the old one. One version for all tables, or none."""
        base = self.version()
        known = self.manifest(base)["tables"]

        def after(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
            if name not in known:
                return rows
            old = self.read(name, base)
            return old.join(rows.select(*keys), keys, "left_anti").select(*old.columns).unionByName(rows)

        return self._commit(base, {name: {"schema": _ddl(rows), "parts": {"all": self._written(after(name, rows, keys))}} for name, (rows, keys) in tables.items()})

    def replace_documents(self, name: str, rows: DataFrame, documents: DataFrame, key: str, buckets: int = BUCKETS) -> int:
        """All rows of the named documents (key) are replaced by `rows`; a document without any is deleted.

        Only the buckets that hold one of them are written anew. Run again, it leaves the same rows.
        """
        base = self.version()
        found = self.manifest(base)["tables"].get(name, {"schema": _ddl(rows), "parts": {}})
        at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        documents = written(documents.select(key).distinct())[0]
        touched = sorted(r.bucket for r in documents.select(at.alias("bucket")).distinct().collect())  # at most `buckets`
        old = self._parts(found["schema"], [found["parts"][str(b)] for b in touched if str(b) in found["parts"]])
        kept = old.join(documents, key, "left_anti").select(*rows.columns)
        path = f"data/{uuid.uuid4().hex}"
        new = kept.unionByName(rows.join(documents, key, "left_semi").select(*rows.columns)).withColumn("_bucket", at)
        # A bucket's rows are dealt over as many tasks as they fill: the buckets stay as many while the table grows.
        new.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{path}")
        filled = {f.getPath().getName() for f in self._fs.listStatus(self._at(path))}
        parts = {b: p for b, p in found["parts"].items() if int(b) not in touched}
        parts |= {str(b): f"{path}/_bucket={b}" for b in touched if f"_bucket={b}" in filled}
        return self._commit(base, {name: {"schema": found["schema"], "parts": parts}})

    def refresh(self, name: str, fresh: DataFrame, key: str, stamp: str, started: Column, mark: tuple[str, Column] | None = None) -> dict:
        """A projection after a run: the fresh rows replace their keys', and rows that are still older than the run's start (`stamp` < started) are swept.

        mark: (column, value) set on every row that stays. Without a fresh row nothing changes, as a run that failed whole must not
        empty the table. Gives {"fresh", "removed", "version"}.
        """
        base = self.version()
        fresh, seen = written(fresh.where(F.col(stamp) >= started), F.count(F.lit(1)).alias("n"))
        drop = lambda: drop_table(self.spark, seen["path"])
        if not seen["n"]:
            drop()
            return {"fresh": 0, "removed": 0, "version": base}
        stay, removed = fresh, 0
        if name in self.manifest(base)["tables"]:
            old = self.read(name, base)
            rest = old.join(fresh.select(key), key, "left_anti").select(*old.columns)
            removed = rest.where(F.col(stamp) < started).count()
            stay = rest.where(F.col(stamp) >= started).unionByName(fresh)
        if mark:
            stay = stay.withColumn(*mark)
        version = self._commit(base, {name: {"schema": _ddl(stay), "parts": {"all": self._written(stay)}}})
        drop()
        return {"fresh": seen["n"], "removed": removed, "version": version}

    def vacuum(self, keep: int = 2) -> int:
        """Drops data that none of the last `keep` manifests names, and older manifests; gives the number of dropped folders."""
        newest = self.version()
        alive = [v for v in range(max(1, newest - keep + 1), newest + 1) if self._fs.exists(self._at(f"manifests/{v:012d}.json"))]
        named = {p.split("/")[1] for v in alive for t in self.manifest(v)["tables"].values() for p in t["parts"].values()}
        for f in self._fs.listStatus(self._at("manifests")):
            if f.getPath().getName() not in {f"{v:012d}.json" for v in alive}:
                self._fs.delete(f.getPath(), False)
        gone = [f.getPath() for f in self._fs.listStatus(self._at("data")) if f.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def _ddl(df: DataFrame) -> str:
    return df.schema.json()


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
