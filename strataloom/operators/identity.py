"""Stable identity of symbols: keys, fingerprints, renames, reconciliation of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bodies shorter than this once white space is normalised have no fingerprint.
MIN_FINGERPRINT = 64


def fingerprint(body: Column) -> Column:
    bare = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(bare) >= MIN_FINGERPRINT, F.sha2(bare, 256))


def symbol_keys(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, project_id, path, kind, name, symbol_key, fingerprint): ``path#kind:name``, repeats numbered ``~2`` on by line then id."""
    same = Window.partitionBy("file_id", "kind", "name").orderBy(F.col("start_line").asc_nulls_last(), "id")
    rows = symbols.select("id", "project_id", "file_id", "kind", "name", "start_line", "body").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    n = F.row_number().over(same)
    rows = rows.withColumn("n", n)
    key = F.concat("path", F.lit("#"), "kind", F.lit(":"), "name", F.when(F.col("n") > 1, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return rows.select("id", "project_id", "path", "kind", "name", key.alias("symbol_key"), fingerprint(F.col("body")).alias("fingerprint"))


def match_renames(retired: DataFrame, appeared: DataFrame) -> DataFrame:
    """(project_id, old_key, new_key, how): first by fingerprint, then by kind and name; only where both sides are unique.

    Both frames: project_id, symbol_key, kind, name, fingerprint. Rows claimed by the first pass are out of the second.
    """

    def unique(df: DataFrame, by: list[str], out: str) -> DataFrame:
        keyed = df
        for c in by:
            keyed = keyed.filter(F.col(c).isNotNull())
        return keyed.groupBy("project_id", *by).agg(F.min("symbol_key").alias(out), F.count("*").alias("c")).filter("c = 1").drop("c")

    first = unique(retired, ["fingerprint"], "old_key").join(unique(appeared, ["fingerprint"], "new_key"), ["project_id", "fingerprint"]).select("project_id", "old_key", "new_key", F.lit("fingerprint").alias("how"))
    rest_old = retired.join(first.select("project_id", F.col("old_key").alias("symbol_key")), ["project_id", "symbol_key"], "left_anti")
    rest_new = appeared.join(first.select("project_id", F.col("new_key").alias("symbol_key")), ["project_id", "symbol_key"], "left_anti")
    second = unique(rest_old, ["kind", "name"], "old_key").join(unique(rest_new, ["kind", "name"], "new_key"), ["project_id", "kind", "name"]).select("project_id", "old_key", "new_key", F.lit("name").alias("how"))
    return first.unionByName(second)


def reconcile(entities: DataFrame, present: DataFrame, as_of: Column) -> DataFrame:
    """The identity table after a scan: project_id, natural_key, entity_id, title, deleted_at, state.

    ``entities``: project_id, natural_key, entity_id, title, deleted_at; ``present``: project_id, natural_key, title.
    Known keys keep their id and lose a tombstone, unknown ones get an id from their key, absent ones a tombstone; ids are never reused.
    """
    old = entities.select("project_id", "natural_key", "entity_id", F.col("title").alias("old_title"), "deleted_at")
    new = present.select("project_id", "natural_key", "title", F.lit(True).alias("here"))
    both = old.join(new, ["project_id", "natural_key"], "full_outer")
    state = F.when(F.col("here").isNull(), F.when(F.col("deleted_at").isNull(), "retired").otherwise("gone")).when(F.col("entity_id").isNull(), "new").when(F.col("deleted_at").isNotNull(), "returned").otherwise("kept")
    return both.select(
        "project_id", "natural_key", F.coalesce("entity_id", F.xxhash64("project_id", "natural_key")).alias("entity_id"), F.coalesce("title", "old_title").alias("title"),
        F.when(F.col("here").isNull(), F.coalesce("deleted_at", as_of)).alias("deleted_at"), state.alias("state"),
    )
