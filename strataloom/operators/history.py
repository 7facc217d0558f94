"""Commit history: targets, timelines, owners, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.messages import person_key

HALF_LIFE_DAYS = 180.0


def unique_commits(commits: DataFrame) -> DataFrame:
    """One row per (project_id, sha): the reading with the smallest entity id."""
    w = Window.partitionBy("project_id", "sha").orderBy("entity_id")
    return commits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def decay(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ^ (age / half-life); ages in the future and a half-life of 0 weigh 1."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(F.greatest(age_days, F.lit(0.0)) * (-0.6931471805599453 / half_life))


def age_days(at: Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", at, as_of) / 86400.0


def in_directory(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, literally."""
    return (path == folder) | F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def path_touches(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Touches of commits that have arrived: commit columns, path, additions, deletions; empty paths left out."""
    touched = commit_files.filter("path IS NOT NULL AND path <> ''").select(F.col("commit_entity_id").alias("entity_id"), "path", "additions", "deletions")
    return touched.join(commits, "entity_id")


def timeline(commits: DataFrame, commit_files: DataFrame, folder: str, top_paths: int = 5) -> DataFrame:
    """Commits that touch the folder, with their most churned paths, newest first by (authored_at, sha)."""
    ours = unique_commits(commits).select("entity_id", "project_id", "sha", "subject", F.col("author_name").alias("author"), "authored_at", "is_fix")
    touched = path_touches(ours, commit_files)
    hit = touched.filter(in_directory(F.col("path"), folder)).select("entity_id").distinct()
    churn = touched.groupBy("entity_id", "path").agg(F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn"))
    rank = Window.partitionBy("entity_id").orderBy(F.col("churn").desc(), "path")
    best = churn.join(hit, "entity_id", "left_semi").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top_paths)
    paths = best.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))
    return ours.join(paths, "entity_id").select("project_id", "sha", "subject", "author", "authored_at", "is_fix", F.array_join("paths", ",").alias("paths"))


def summary(commits: DataFrame) -> DataFrame:
    """Per project: commits, fixes, reverts, merges, contributors, first and last commit."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    return unique_commits(commits).groupBy("project_id").agg(
        F.count("*").alias("commits"), F.count_if(F.col("is_fix")).alias("fixes"), F.count_if(F.col("is_revert")).alias("reverts"), F.count_if(F.col("is_merge")).alias("merges"),
        F.countDistinct(who).alias("contributors"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"),
    )


def owners(commits: DataFrame, as_of: Column, limit: int = 10, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Per project the people with the largest recency-weighted commit count; merges left out; the share is over those returned."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    rows = unique_commits(commits).filter("NOT coalesce(is_merge, false)").withColumn("person", who)
    weighed = rows.withColumn("w", decay(age_days(F.col("authored_at"), as_of), half_life)).groupBy("project_id", "person").agg(
        F.round(F.sum("w"), 4).alias("weight"), F.count("*").alias("commits"), F.count_if(F.col("is_fix")).alias("fixes"), F.max("authored_at").alias("last_at"), F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn")
    )
    rank = Window.partitionBy("project_id").orderBy(F.col("weight").desc(), "person")
    top = weighed.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)
    return top.withColumn("share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("project_id")), 4))


def owners_within(commits: DataFrame, commit_files: DataFrame, as_of: Column, folder: str, limit: int = 10, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Owners of a folder: commits that touch it, and of their churn only what lies in it. Columns: project_id, person, weight, commits, churn, rank."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    ours = unique_commits(commits).filter("NOT coalesce(is_merge, false)").select("entity_id", "project_id", "authored_at", who.alias("person"))
    inside = path_touches(ours.select("entity_id"), commit_files).filter(in_directory(F.col("path"), folder))
    churn = inside.groupBy("entity_id").agg(F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn"))
    weighed = ours.join(churn, "entity_id").withColumn("w", decay(age_days(F.col("authored_at"), as_of), half_life)).groupBy("project_id", "person")
    rows = weighed.agg(F.round(F.sum("w"), 4).alias("weight"), F.count("*").alias("commits"), F.sum("churn").alias("churn"))
    rank = Window.partitionBy("project_id").orderBy(F.col("weight").desc(), "person")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)


def latest_of_people(commits: DataFrame) -> DataFrame:
    """(project_id, person, sha, subject): the most recent commit of each person."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    order = Window.partitionBy("project_id", "person").orderBy(F.col("authored_at").desc_nulls_last(), "sha")
    rows = unique_commits(commits).withColumn("person", who).withColumn("n", F.row_number().over(order))
    return rows.filter("n = 1").select("project_id", "person", "sha", "subject")


def people(commits: DataFrame) -> DataFrame:
    """(project_id, person, commits, first_at, last_at, emails): authorship only."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    return unique_commits(commits).groupBy("project_id", who.alias("person")).agg(
        F.count("*").alias("commits"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("author_email")), ",").alias("emails")
    )


def resolve_target(target: str, files: DataFrame, symbols: DataFrame, commit_files: DataFrame, limit: int = 5000) -> DataFrame:
    """(project_id, how, path): an exact file, else files of symbols of that name, else the paths below a folder; each project by its first hit."""
    as_file = files.filter(F.col("path") == target).select("project_id", F.lit(1).alias("o"), F.lit("file").alias("how"), "path")
    named = symbols.filter((F.col("name") == target) | F.endswith("name", F.lit("::" + target))).select("file_id")
    as_symbol = files.join(named.distinct(), files["id"] == named["file_id"], "left_semi").select("project_id", F.lit(2).alias("o"), F.lit("symbol").alias("how"), "path")
    below = commit_files.filter(F.startswith("path", F.lit(target.rstrip("/") + "/"))).select("project_id", "path").distinct()
    order = Window.partitionBy("project_id").orderBy("path")
    as_folder = below.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).select("project_id", F.lit(3).alias("o"), F.lit("directory").alias("how"), "path")
    found = as_file.unionByName(as_symbol).unionByName(as_folder)
    first = Window.partitionBy("project_id")
    return found.withColumn("m", F.min("o").over(first)).filter("o = m").select("project_id", "how", "path").distinct()
