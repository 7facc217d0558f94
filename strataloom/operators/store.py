"""Keyed merges and snapshots without a table format: full-outer merges, atomic folders, a manifest of watermarks."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a column of the merged row comes from the old and the new one.
Rule = Callable[[Column, Column], Column]
replace: Rule = lambda old, new: new
keep_old: Rule = lambda old, new: F.coalesce(old, new)
prefer_new: Rule = lambda old, new: F.coalesce(new, old)


def array_union(old: Column, new: Column) -> Column:
    """Distinct non-null entries of both; null only if both are."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.when(old.isNotNull() | new.isNotNull(), F.array_sort(F.array_distinct(F.array_compact(both))))


def map_merge(old: Column, new: Column) -> Column:
    """Shallow merge, the new entries winning; null only if both are."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(old, new))


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule], default: Rule = prefer_new) -> DataFrame:
    """``old`` updated by ``new``: rows of either side alone stay as they are, common ones follow the rule of each column. Idempotent for all rules here."""
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__new"))
    both = a.join(b, keys, "full_outer")
    cell = lambda c: F.when(F.col("__new").isNull(), F.col(f"__o_{c}")).when(F.col("__old").isNull(), F.col(f"__n_{c}")).otherwise(rules.get(c, default)(F.col(f"__o_{c}"), F.col(f"__n_{c}"))).alias(c)
    return both.select(*keys, *map(cell, columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, once each."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of files that did not change, and the new rows of those that did."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def refresh_chunks(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks after a re-chunking: an embedding survives only where the content hash is the same; orders beyond the new end are gone."""
    before = old.select(*keys, F.col("content_hash").alias("old_hash"), F.col("embedding").alias("old_embedding"))
    joined = new.drop("embedding").join(before, keys, "left")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    return joined.withColumn("embedding", F.when(same, F.col("old_embedding"))).drop("old_hash", "old_embedding")


def changed_files(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(project_id, path, change): added, changed or removed between two manifests of (project_id, path, hash)."""
    a = manifest.select("project_id", "path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    b = present.select("project_id", "path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    rows = a.join(b, ["project_id", "path"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return rows.select("project_id", "path", change.alias("change")).filter("change IS NOT NULL")


class Snapshots:
    """Versions of named tables under one shared folder, with a manifest that names the current ones.

    A table is a list of parts: ``commit`` replaces them, ``append`` adds one, so that an increment costs its
    own size. A part is written whole before the manifest names it; a run that dies leaves the old state
    current. The manifest is one small file under the number after the one that was read; of two writers that
    read the same manifest the second is refused.
    """

    #: Manifests kept for readers that have just read them.
    KEEP = 10

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-"))

    def _file(self, number: int) -> str:
        return f"{self.root}/manifest-{number:012d}.json"

    def _load(self) -> tuple[int, dict]:
        """(number of the newest manifest, its tables)."""
        numbers = self._numbers()
        if not numbers:
            return -1, {}
        text = "\n".join(r.value for r in self.spark.read.text(self._file(numbers[-1]), wholetext=True).collect())
        return numbers[-1], json.loads(text)

    def manifest(self) -> dict:
        """Table to {parts, watermark, rows, at}; the newest manifest counts."""
        return self._load()[1]

    def read(self, table: str) -> DataFrame | None:
        entry = self.manifest().get(table)
        return self.spark.read.parquet(*[f"{self.root}/{table}/{p}" for p in entry["parts"]]) if entry else None

    def _write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> tuple[str, int]:
        part = uuid.uuid4().hex
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{part}")
        return part, self.spark.read.parquet(f"{self.root}/{table}/{part}").count()

    def _move(self, read: int, state: dict) -> None:
        """Makes ``state`` current unless another manifest came after the one that was read."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        draft, target = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self._path(self._file(read + 1))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, target, options)
        except Exception as e:  # the target exists
            self._fs.delete(draft, False)
            raise RuntimeError("another writer committed first") from e
        for old in self._numbers()[: -self.KEEP]:
            self._fs.delete(self._path(self._file(old)), False)

    def commit_all(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, watermark: str | None = None, partition_by: list[str] | None = None) -> dict:
        """Replaces and extends tables under one move of the manifest: all of them or none."""
        read, state = self._load()
        now = time.time()
        for table, df in replaced.items():
            part, rows = self._write(table, df, partition_by)
            state[table] = {"parts": [part], "watermark": watermark, "rows": rows, "at": now}
        for table, df in (appended or {}).items():
            part, rows = self._write(table, df, partition_by)
            old = state.get(table, {"parts": [], "rows": 0})
            state[table] = {"parts": [*old["parts"], part], "watermark": watermark, "rows": old["rows"] + rows, "at": now}
        self._move(read, state)
        return state

    def commit(self, table: str, df: DataFrame, watermark: str | None = None, partition_by: list[str] | None = None) -> dict:
        return self.commit_all({table: df}, None, watermark, partition_by)[table]

    def append(self, table: str, df: DataFrame, watermark: str | None = None) -> dict:
        return self.commit_all({}, {table: df}, watermark)[table]

    def commit_if_changed(self, table: str, make: Callable[[], DataFrame], watermark: str) -> bool:
        """Runs and commits a derivation unless its watermark is the recorded one; a failure leaves it unset."""
        if self.manifest().get(table, {}).get("watermark") == watermark:
            return False
        self.commit(table, make(), watermark)
        return True

    def drop(self, *tables: str) -> int:
        """Forgets tables; returns the rows they had (the preview a caller may show first comes from ``manifest``)."""
        read, state = self._load()
        rows = sum(state.pop(t, {"rows": 0})["rows"] for t in tables)
        self._move(read, state)
        return rows

    def vacuum(self) -> int:
        """Deletes parts that no kept manifest names; returns how many."""
        named = set()
        for number in self._numbers():
            text = "\n".join(r.value for r in self.spark.read.text(self._file(number), wholetext=True).collect())
            named |= {(t, p) for t, e in json.loads(text).items() for p in e["parts"]}
        gone = 0
        for folder in self._fs.listStatus(self._path(self.root)):
            if folder.isDirectory():
                for part in self._fs.listStatus(folder.getPath()):
                    if (folder.getPath().getName(), part.getPath().getName()) not in named:
                        gone += bool(self._fs.delete(part.getPath(), True))
        return gone
