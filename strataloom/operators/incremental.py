"""Exactly-once selection of new or changed records from a feed of runs.

The feed is reread from the oldest run still open (failed or aborted) at the
last successful run, and the overlap this causes is removed by anti-joining
key-and-version pairs against the ledger of what was already counted.

Defined results: null paths and rows with an error are void; a null
``is_deleted`` is no deletion; repeated rows count once; of two rows observed
at the same instant the one with the larger row id counts; a run whose project
or start is null covers nothing; empty inputs give an empty result. Only the
columns named here are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def covering_runs(runs: DataFrame, ok: str = "ok") -> DataFrame:
    """For each run the successful run that processes its rows: itself, or the next successful one.

    Rows of an unsuccessful run are thereby reread by the next success (the low-water mark
    is the oldest run open since the last success) and no run's rows are read by two.
    """
    later = Window.partitionBy("project_id").orderBy("started_at", "run_id").rowsBetween(0, Window.unboundedFollowing)
    success = F.when(F.col("status") == ok, F.struct("started_at", "run_id"))
    return (
        runs.filter("run_id IS NOT NULL AND project_id IS NOT NULL AND started_at IS NOT NULL")
        .select("run_id", F.first(success, ignorenulls=True).over(later).alias("by"))
        .filter("by IS NOT NULL")
        .select("run_id", F.col("by.run_id").alias("by_run"), F.col("by.started_at").alias("by_start"))
    )


def last_per_run(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last observation of each key in each run: ``rows`` has the keys, at, run_id, observed_at, row_id, version, is_deleted and maybe more."""
    rest = [c for c in rows.columns if c not in (*keys, "at", "run_id", "observed_at", "row_id")]
    last = F.max(F.struct("observed_at", "row_id", *rest)).alias("_last")
    return rows.groupBy(*keys, "at", "run_id").agg(last).select(*keys, "at", "run_id", "_last.observed_at", *[F.col(f"_last.{c}").alias(c) for c in rest])


def counted_changes(rows: DataFrame, state: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Counted observations in order of (at, run_id), each with the version known before it.

    ``rows`` are those reread (see ``last_per_run``), ``processed`` the pairs of key and version (version,
    observed_at) already in the ledger, which are taken out by an anti-join, and ``state`` the last counted
    version, observed_at and is_deleted of each key. An observation counts only if it is later than every
    counted one before it. Columns: those of ``last_per_run`` and known_version (null after a deletion).
    """
    fresh = rows.join(processed.select(*keys, "version", "observed_at"), [*keys, "version", "observed_at"], "left_anti")
    last = last_per_run(fresh, keys)
    none = [F.lit(None).cast(last.schema[c].dataType).alias(c) for c in last.columns if c not in (*keys, "observed_at", "version", "is_deleted")]
    start = state.select(*keys, F.col("observed_at").cast(last.schema["observed_at"].dataType).alias("observed_at"), "version", "is_deleted", *none)
    order = Window.partitionBy(*keys).orderBy(F.col("at").asc_nulls_first(), F.col("run_id").asc_nulls_first())
    before = F.max("observed_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    counted = start.unionByName(last).withColumn("_seen", before).filter("run_id IS NULL OR _seen IS NULL OR observed_at > _seen").drop("_seen")
    known = F.lag(F.when(~F.col("is_deleted"), F.col("version"))).over(order)
    return counted.withColumn("known_version", known).filter("run_id IS NOT NULL")


def news(changes: DataFrame) -> DataFrame:
    """Counted observations that must be processed: present, and unlike the version known before."""
    return changes.filter("NOT is_deleted AND (known_version IS NULL OR NOT (version <=> known_version))")


def files_to_process(observations: DataFrame, runs: DataFrame, manifest: DataFrame, low_water: int | None = None) -> DataFrame:
    """(run_id, project_id, path) that each successful run must process.

    All runs of the feed are advanced in one plan. ``low_water`` is the oldest run open when the manifest
    was left; rows of older runs are not read.
    """
    keys = ["project_id", "path"]
    if low_water is not None:
        observations, runs = observations.filter(F.col("run_id") >= low_water), runs.filter(F.col("run_id") >= low_water)
    known = manifest.filter("project_id IS NOT NULL AND path IS NOT NULL").select(
        "project_id", canonical_path(F.col("path")).alias("path"), F.lower("hash").alias("version"), F.col("updated_at").cast("timestamp_ntz").alias("observed_at"), F.lit(False).alias("is_deleted")
    )
    rows = observations.filter("error IS NULL AND path IS NOT NULL AND observed_at IS NOT NULL").select(
        "row_id", "run_id", "project_id", canonical_path(F.col("path")).alias("path"), F.lower("hash").alias("version"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted")
    )
    covered = rows.join(covering_runs(runs), "run_id").drop("run_id").withColumnsRenamed({"by_run": "run_id", "by_start": "at"})
    return news(counted_changes(covered, known, known, keys)).select("run_id", *keys)
