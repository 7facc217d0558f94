"""Exactly-once processing of a feed in runs.

A run rereads from the oldest run that was open when the last success was recorded (older runs are not
scanned), takes the pairs of key and version that are in the ledger out by an anti-join, counts an observation
only if it is later than the key's last counted one, writes its output, its state and the ledger, and moves the
manifest once for all three. A run that dies before leaves no trace that counts; run again, it does the same
work and ends in the same state.

Tables: ``output`` and ``state`` grow by one part per run, of the size of the increment; ``state`` holds the
version, observed_at and is_deleted of the keys that the run counted, and is folded into one part every
``fold_after`` runs. ``ledger`` holds the pairs of the runs that can still be reread, not of all time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.incremental import counted_changes, news
from strataloom.operators.store import Snapshots


class IncrementalRuns:
    """``source`` has run_id, the keys, version, observed_at, is_deleted and whatever ``work`` needs; run ids grow with time.

    Rows without a key, version order or time: a null key or observed_at is void, a null is_deleted is no deletion.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("key",), fold_after: int = 16):
        self.spark, self.store, self.keys, self.fold_after = spark, Snapshots(spark, root), list(keys), fold_after

    def marks(self) -> tuple[int | None, int | None]:
        """(last recorded run, oldest run to reread)."""
        entry = self.store.manifest().get("state")
        return tuple(int(x) for x in entry["watermark"].split(":")) if entry else (None, None)

    def _rows(self, source: DataFrame, run_id: int, low: int | None) -> DataFrame:
        """The rows from the low-water mark to this run, the covering run being this one."""
        bounded = source.filter(F.col("run_id") <= run_id)
        if low is not None:
            bounded = bounded.filter(F.col("run_id") >= low)
        valid = bounded.filter(" AND ".join(f"{k} IS NOT NULL" for k in [*self.keys, "observed_at"]))
        return valid.select(*self.keys, F.lit(None).cast("int").alias("at"), F.lit(run_id).cast("bigint").alias("run_id"), "observed_at", F.col("run_id").cast("bigint").alias("row_id"), "version", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), F.struct(*source.columns).alias("row"))

    def _none(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, "version", "observed_at", "is_deleted", F.col("row_id").alias("run_id")).limit(0)

    def latest(self, state: DataFrame) -> DataFrame:
        """The last counted version of each key over the parts of the state."""
        newest = Window.partitionBy(*self.keys).orderBy(F.col("observed_at").desc(), F.col("run_id").desc())
        return state.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def pending(self, source: DataFrame, run_id: int) -> DataFrame:
        """Counted changes that this run would record, with the whole source row as ``row``."""
        rows = self._rows(source, run_id, self.marks()[1])
        state, ledger = self.store.read("state"), self.store.read("ledger")
        none = self._none(rows)
        # Only the keys at hand are taken from the state, before its parts are folded.
        known = none if state is None else self.latest(state.join(rows.select(*self.keys).distinct(), self.keys, "left_semi"))
        return counted_changes(rows, known.drop("run_id"), none if ledger is None else ledger, self.keys)

    def run(self, source: DataFrame, run_id: int, oldest_open: int | None, work: Callable[[DataFrame], DataFrame]) -> bool:
        """Processes what is pending for this run; False if the run is already recorded. ``oldest_open`` is kept for the next run."""
        done, low = self.marks()
        if done is not None and run_id <= done:
            return False
        next_low = min(oldest_open, run_id + 1) if oldest_open is not None else run_id + 1
        changes = self.pending(source, run_id)
        output = work(news(changes).select("row.*"))
        counted = changes.select(*self.keys, "version", "observed_at", "is_deleted", F.col("run_id").cast("bigint").alias("run_id"))
        old, old_ledger = self.store.read("state"), self.store.read("ledger")
        # Pairs of runs below the next mark are never reread, so the ledger does not keep them.
        read = self._rows(source, run_id, low).select(*self.keys, "version", "observed_at", "is_deleted", F.col("row_id").alias("run_id"))
        ledger = (read if old_ledger is None else old_ledger.unionByName(read)).filter(F.col("run_id") >= next_low).dropDuplicates([*self.keys, "version", "observed_at"])
        entry = self.store.manifest().get("state")
        fold = entry is not None and len(entry["parts"]) >= self.fold_after
        replaced, appended = {"ledger": ledger}, {"output": output}
        if fold:
            replaced["state"] = self.latest(old.unionByName(counted))
        else:
            appended["state"] = counted
        self.store.commit_all(replaced, appended, f"{run_id}:{next_low}")
        return True

    def current(self) -> DataFrame | None:
        """Keys that exist now, with their last counted version."""
        state = self.store.read("state")
        return None if state is None else self.latest(state).filter("NOT is_deleted")
