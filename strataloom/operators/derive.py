"""Derived intelligence: modules, metrics, risk, ownership, co-change, clusters.

Decisions where the definition leaves room: merges are left out of metrics, co-change
and ownership; churn counts for the module of the path, restricted to modules that
exist; lift's N is all commits in scope; the window ends at ``as_of``; without any fix
in the project the risk is the share of the largest churn, linearly; rounding only on output.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.messages import person_key
from strataloom.functions.text import cluster_tokens, module_path
from strataloom.operators.history import age_days, decay, path_touches, unique_commits


def modules(files: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(project_id, module, files, loc, symbols)."""
    per_file = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("s"))
    rows = files.select("project_id", "id", module_path(F.col("path"), depth).alias("module"), "loc").join(per_file, "id", "left")
    return rows.groupBy("project_id", "module").agg(F.count("*").alias("files"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.sum(F.coalesce("s", F.lit(0))).alias("symbols"))


def module_dependencies(resolved: DataFrame, symbols: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """(project_id, from_module, to_module, edges) between different modules."""
    home = symbols.select("id", "file_id").join(files.select(F.col("id").alias("file_id"), module_path(F.col("path"), depth).alias("m")), "file_id").select("id", "m")
    rows = resolved.filter("dst IS NOT NULL").join(home.select(F.col("id").alias("src"), F.col("m").alias("from_module")), "src").join(home.select(F.col("id").alias("dst"), F.col("m").alias("to_module")), "dst")
    return rows.filter("from_module <> to_module").groupBy("project_id", "from_module", "to_module").agg(F.count("*").alias("edges"))


def risk_score(churn: Column, density: Column, max_churn: Column, any_fix: Column) -> Column:
    """0..100: root of churn share times defect density; by churn alone if the project has no fix; 0 without churn."""
    share = churn / max_churn
    return F.when(max_churn <= 0, 0.0).otherwise(100.0 * F.when(any_fix, F.sqrt(share * F.least(F.greatest(density, F.lit(0.0)), F.lit(1.0)))).otherwise(share))


def module_metrics(commits: DataFrame, commit_files: DataFrame, files: DataFrame, as_of: Column, window_days: int = 90, depth: int = 2) -> DataFrame:
    """Per module over the trailing window: commits, fixes, authors, additions, deletions, churn, density, risk."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    age = age_days(F.col("authored_at"), as_of)
    scope = unique_commits(commits).filter("NOT coalesce(is_merge, false)").withColumn("person", who).filter(age.between(0, window_days)).select("entity_id", "project_id", "is_fix", "person")
    touched = path_touches(scope, commit_files).withColumn("module", module_path(F.col("path"), depth))
    known = files.select("project_id", module_path(F.col("path"), depth).alias("module")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = touched.join(known, ["project_id", "module"], "left_semi").groupBy("project_id", "module").agg(
        F.countDistinct("entity_id").alias("commits"), F.countDistinct(F.when(F.col("is_fix"), F.col("entity_id"))).alias("fix_commits"), F.countDistinct("person").alias("authors"),
        F.sum(zero("additions")).alias("additions"), F.sum(zero("deletions")).alias("deletions"),
    )
    project = Window.partitionBy("project_id")
    out = per.withColumn("churn", F.col("additions") + F.col("deletions")).withColumn("density", F.col("fix_commits") / F.col("commits"))
    out = out.withColumn("m", F.max("churn").over(project)).withColumn("f", F.max(F.col("fix_commits") > 0).over(project))
    return out.withColumn("risk", risk_score(F.col("churn"), F.col("density"), F.col("m"), F.col("f"))).drop("m", "f")


def module_owners(commits: DataFrame, commit_files: DataFrame, files: DataFrame, as_of: Column, half_life: float = 180.0, depth: int = 2) -> DataFrame:
    """(project_id, module, person, weight, share, commits, last_at): recency-weighted churn, shares adding to 1."""
    who = person_key(F.col("author_name"), F.col("author_email"))
    ours = unique_commits(commits).filter("NOT coalesce(is_merge, false)").select("entity_id", "project_id", who.alias("person"), "authored_at")
    touched = path_touches(ours, commit_files).withColumn("module", module_path(F.col("path"), depth))
    known = files.select("project_id", module_path(F.col("path"), depth).alias("module")).distinct()
    churn = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    per = touched.join(known, ["project_id", "module"], "left_semi").groupBy("project_id", "module", "person").agg(
        F.sum(churn * decay(age_days(F.col("authored_at"), as_of), half_life)).alias("weight"), F.countDistinct("entity_id").alias("commits"), F.max("authored_at").alias("last_at")
    )
    whole = F.sum("weight").over(Window.partitionBy("project_id", "module"))
    return per.withColumn("share", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0))


def cochange(commits: DataFrame, commit_files: DataFrame, min_pair: int = 2, max_files: int = 50) -> DataFrame:
    """(project_id, path_a, path_b, pair_commits, a_commits, b_commits, confidence, lift) with path_a < path_b.

    Commits of more than ``max_files`` paths (0: none is too large) give no pairs but count for their paths. Paths in
    fewer than ``min_pair`` commits are left out before the self-join, which loses no pair.
    """
    scope = unique_commits(commits).filter("NOT coalesce(is_merge, false)").select("entity_id", "project_id")
    touched = path_touches(scope, commit_files).select("project_id", "entity_id", "path").distinct()
    total = scope.groupBy("project_id").agg(F.count("*").alias("n"))
    per_path = touched.groupBy("project_id", "path").agg(F.count("*").alias("c")).filter(F.col("c") >= min_pair)
    sizes = touched.groupBy("entity_id").agg(F.count("*").alias("s")).filter("s > 1" + (f" AND s <= {max_files}" if max_files else "")).select("entity_id")
    kept = touched.join(sizes, "entity_id", "left_semi").join(per_path.select("project_id", "path"), ["project_id", "path"], "left_semi")
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, F.expr("x.entity_id = y.entity_id AND x.path < y.path")).groupBy("x.project_id", F.col("x.path").alias("path_a"), F.col("y.path").alias("path_b")).agg(F.count("*").alias("pair_commits"))
    one, two = (per_path.select("project_id", F.col("path").alias(f"path_{k}"), F.col("c").alias(f"{k}_commits")) for k in "ab")
    out = pairs.filter(F.col("pair_commits") >= min_pair).join(one, ["project_id", "path_a"]).join(two, ["project_id", "path_b"]).join(total, "project_id")
    return out.select(
        "project_id", "path_a", "path_b", "pair_commits", "a_commits", "b_commits",
        (F.col("pair_commits") / F.least("a_commits", "b_commits")).alias("confidence"), (F.col("pair_commits") * F.col("n") / (F.col("a_commits") * F.col("b_commits"))).alias("lift"),
    )


def cochange_of(pairs: DataFrame, folder: str, limit: int = 15) -> DataFrame:
    """What changes together with a folder's files, pairs wholly inside it left out, strongest first."""
    inside = lambda c: (F.col(c) == folder) | F.startswith(c, F.lit(folder.rstrip("/") + "/"))
    rows = pairs.filter(inside("path_a") != inside("path_b"))
    rows = rows.select("project_id", F.when(inside("path_a"), F.col("path_a")).otherwise(F.col("path_b")).alias("path"), F.when(inside("path_a"), F.col("path_b")).otherwise(F.col("path_a")).alias("other"), "pair_commits", "confidence")
    best = Window.partitionBy("project_id").orderBy(F.col("confidence").desc(), F.col("pair_commits").desc(), "other", "path")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def dominant_module(commits: DataFrame, commit_files: DataFrame, depth: int = 2) -> DataFrame:
    """(entity_id, module, touches): the module most touched by each commit, ties by name."""
    touched = path_touches(unique_commits(commits).select("entity_id", "project_id"), commit_files)
    per = touched.groupBy("entity_id", module_path(F.col("path"), depth).alias("module")).agg(F.count("*").alias("touches"))
    first = Window.partitionBy("entity_id").orderBy(F.col("touches").desc(), "module")
    return per.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def term_frequencies(docs: DataFrame, group: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((group, key, term), (group, term, df)) of the terms worth clustering on."""
    terms = docs.select(group, key, F.explode(F.array_distinct(cluster_tokens(F.col(text)))).alias("term"))
    return terms, terms.groupBy(group, "term").agg(F.count("*").alias("df"))


def bucket_terms(docs: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, term): each text's most widespread term, ties by the alphabet."""
    terms, df = term_frequencies(docs, group, key, text)
    first = Window.partitionBy(group, key).orderBy(F.col("df").desc(), "term")
    return terms.join(df, [group, "term"]).withColumn("r", F.row_number().over(first)).filter("r = 1").select(group, key, "term", "df")


def top_terms(members: DataFrame, group: str, bucket: str, key: str, text: str, keep: int = 3) -> DataFrame:
    """(group, bucket, rank, term, score): inside share times log of inside over outside share, smoothed by 1 / (N + 1)."""
    terms = members.select(group, bucket, key, F.explode(F.array_distinct(cluster_tokens(F.col(text)))).alias("term"))
    sizes = members.groupBy(group, bucket).agg(F.count("*").alias("size"))
    whole = members.groupBy(group).agg(F.count("*").alias("n"))
    inside = terms.groupBy(group, bucket, "term").agg(F.count("*").alias("c"))
    anywhere = terms.groupBy(group, "term").agg(F.count("*").alias("t"))
    rows = inside.join(sizes, [group, bucket]).join(anywhere, [group, "term"]).join(whole, group)
    eps = 1.0 / (F.col("n") + 1)
    share = F.col("c") / F.col("size")
    out = F.when(F.col("n") > F.col("size"), (F.col("t") - F.col("c")) / (F.col("n") - F.col("size"))).otherwise(0.0)
    scored = rows.withColumn("score", F.round(share * F.ln((share + eps) / (out + eps)), 6)).filter("score > 0")
    best = Window.partitionBy(group, bucket).orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).select(group, bucket, "rank", "term", "score")


def _bucketed_fixes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Fixes with their module and term: project_id, entity_id, sha, subject, authored_at, module, term."""
    fixes = unique_commits(commits).filter("is_fix").select("project_id", "entity_id", "sha", "subject", "authored_at")
    bucket = bucket_terms(fixes, "project_id", "entity_id", "subject").select("entity_id", "term")
    home = dominant_module(commits, commit_files).select("entity_id", "module")
    return fixes.join(bucket, "entity_id").join(home, "entity_id", "left").withColumn("module", F.coalesce("module", F.lit("")))


def fix_clusters(commits: DataFrame, commit_files: DataFrame, min_size: int = 2) -> DataFrame:
    """Recurring fixes by (module, term) bucket: project_id, module, term, size, first_at, last_at."""
    rows = _bucketed_fixes(commits, commit_files)
    return rows.groupBy("project_id", "module", "term").agg(F.count("*").alias("size"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at")).filter(F.col("size") >= min_size)


def cluster_examples(commits: DataFrame, commit_files: DataFrame, min_size: int = 2, keep: int = 5) -> DataFrame:
    """(project_id, module, term, n, sha, subject): the newest fixes of every cluster."""
    bucket = ["project_id", "module", "term"]
    order = Window.partitionBy(*bucket).orderBy(F.col("authored_at").desc_nulls_last(), "sha")
    rows = _bucketed_fixes(commits, commit_files).withColumn("n", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy(*bucket)))
    return rows.filter((F.col("size") >= min_size) & (F.col("n") <= keep)).select(*bucket, "n", "sha", "subject")


def leader_clusters(vectors: DataFrame, group: str, key: str, vector: str, threshold: float = 0.82) -> DataFrame:
    """(group, key, cluster, similarity): greedy leader clustering with running-mean centroids, in order of the key.

    Each item joins the most similar centroid at or above the threshold, else opens a cluster: a fold in
    which every step needs the one before, so one group is one task. Groups are the fixes of one project
    and module, the unit whose clusters are reported.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        part = part.sort_values(key, kind="stable")
        centres: list[np.ndarray] = []
        sizes: list[int] = []
        cluster, sims = [], []
        for v in part[vector]:
            x = np.asarray(v, dtype=np.float64)
            best, at = -2.0, -1
            if centres:
                m = np.stack(centres)
                norm = np.linalg.norm(m, axis=1) * np.linalg.norm(x)
                s = np.divide(m @ x, norm, out=np.zeros(len(m)), where=norm > 0)
                at = int(s.argmax())
                best = float(s[at])
            if best >= threshold:
                centres[at] = (centres[at] * sizes[at] + x) / (sizes[at] + 1)
                sizes[at] += 1
            else:
                at, best = len(centres), 1.0
                centres.append(x)
                sizes.append(1)
            cluster.append(at)
            sims.append(best)
        return pd.DataFrame({group: part[group].to_numpy(), key: part[key].to_numpy(), "cluster": cluster, "similarity": sims})

    kinds = dict(vectors.dtypes)
    return vectors.select(group, key, vector).filter(F.col(vector).isNotNull()).groupBy(group).applyInPandas(fold, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster int, similarity double")


def skip_unchanged(kinds: DataFrame, state: DataFrame) -> DataFrame:
    """(project_id, kind, watermark, todo): a derivation runs unless its recorded watermark equals the present one."""
    old = state.select("project_id", "kind", F.col("watermark").alias("old"))
    return kinds.join(old, ["project_id", "kind"], "left").select("project_id", "kind", "watermark", (~F.col("watermark").eqNullSafe(F.col("old")) | F.col("watermark").isNull()).alias("todo"))

