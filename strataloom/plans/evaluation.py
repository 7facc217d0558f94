"""Replaying history as a retrieval benchmark: sampled commits as queries, the files they touched as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.history import path_touches, unique_commits


def sample_commits(commits: DataFrame, commit_files: DataFrame, want: int = 25, most_paths: int = 6) -> DataFrame:
    """(project_id, sha, ord, n_paths): a stride through each project's commits that are no merge or revert, speak and touch few files."""
    ours = unique_commits(commits).filter("NOT coalesce(is_merge, false) AND NOT coalesce(is_revert, false)").select("entity_id", "project_id", "sha", "subject", "authored_at")
    sizes = path_touches(ours, commit_files).groupBy("entity_id").agg(F.countDistinct("path").cast("bigint").alias("n_paths"))
    rows = ours.join(sizes, "entity_id").filter(F.col("n_paths").between(1, most_paths) & (F.length("subject") >= 15) & (F.size(F.split(F.trim("subject"), " ")) >= 3))
    order = Window.partitionBy("project_id").orderBy(F.col("authored_at").asc_nulls_last(), "sha")
    rows = rows.withColumn("ord", F.row_number().over(order).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("project_id")))
    stride = F.greatest(F.floor(F.col("n") / float(want)), F.lit(1))
    return rows.filter((F.col("ord") - 1) % stride == 0).select("project_id", "sha", "ord", "n_paths")


def scores(relevant: DataFrame, hits: DataFrame, by: str, item: str, k: int = 10) -> DataFrame:
    """(queries, recall, hit_rate, mrr): means over the queries of ``relevant`` (by, item) against ranked ``hits`` (by, item, rank)."""
    wanted = relevant.select(by, item).distinct()
    top = hits.filter(F.col("rank") <= k).groupBy(by, item).agg(F.min("rank").alias("rank"))
    joined = wanted.join(top, [by, item], "left").groupBy(by).agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    return joined.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("found") / F.col("n")), 6).alias("recall"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )
