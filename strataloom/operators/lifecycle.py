"""The life of a project's state: modules that stay or go, projects that are deleted, usage, schema steps, derivations, aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import module_path
from strataloom.operators.store import Snapshots


def module_members(files: DataFrame, depth: int = 2) -> DataFrame:
    """(module_id, project_id, module, file_id): an id is a hash of project and path, so a module keeps it from run to run."""
    rows = files.filter("path IS NOT NULL AND project_id IS NOT NULL").select("project_id", module_path(F.col("path"), depth).alias("module"), F.col("id").alias("file_id"))
    return rows.select(F.xxhash64("project_id", "module").alias("module_id"), "project_id", "module", "file_id")


def upsert_modules(old: DataFrame, members: DataFrame) -> DataFrame:
    """(module_id, project_id, module, title, files, change): the modules that have members now; a title given by people survives, modules without members go.

    ``old``: module_id, project_id, module, title. ``change`` is added, kept or pruned; pruned rows are for the log, not the table.
    """
    now = members.groupBy("module_id", "project_id", "module").agg(F.countDistinct("file_id").alias("files"))
    before = old.select("module_id", F.col("project_id").alias("old_project"), F.col("module").alias("old_module"), "title", F.lit(True).alias("was"))
    both = now.join(before, "module_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("files").isNull(), "pruned").otherwise("kept")
    return both.select("module_id", F.coalesce("project_id", "old_project").alias("project_id"), F.coalesce("module", "old_module").alias("module"), "title", F.coalesce("files", F.lit(0)).alias("files"), change.alias("change"))


def without_project(tables: dict[str, DataFrame], project: int, keep_as_null: tuple[str, ...] = ("usage",)) -> dict[str, DataFrame]:
    """The tables after a project is deleted: its rows go with it; rows of ``keep_as_null`` stay and lose their project, as history of use outlives it."""
    out = {}
    for name, df in tables.items():
        key = "id" if name == "projects" else "project_id"
        if name in keep_as_null:
            out[name] = df.withColumn(key, F.when(F.col(key) != project, F.col(key)))
        else:
            out[name] = df.filter(~F.col(key).eqNullSafe(F.lit(project)))
    return out


def delete_project(store: Snapshots, project: int, keep_as_null: tuple[str, ...] = ("usage",)) -> dict[str, int]:
    """Deletes a project from every table of a store that has one, in one move; returns the rows that went."""
    held = {name: store.read(name) for name in store.manifest()}
    held = {name: df for name, df in held.items() if "project_id" in df.columns or name == "projects"}
    before = {name: store.manifest()[name]["rows"] for name in held}
    state = store.commit_all(without_project(held, project, keep_as_null))
    return {name: before[name] - state[name]["rows"] for name in held}


def append_usage(store: Snapshots, used: DataFrame) -> dict:
    """Adds rows of use (project_id, provider, model, tokens); calls without tokens are not recorded."""
    return store.append("usage", used.filter("tokens > 0"))


def migrate(store: Snapshots, steps: list[tuple[str, Callable[[Snapshots], None]]]) -> list[str]:
    """Runs the named steps that the store has not had yet, in order; each is recorded when it is done, so a second call does nothing."""
    spark, done = store.spark, applied_steps(store)
    ran = []
    for name, step in steps:
        if name not in done:
            step(store)
            store.append("schema_steps", spark.createDataFrame([(name, len(done) + len(ran))], "step string, number int"))
            ran.append(name)
    return ran


def applied_steps(store: Snapshots) -> list[str]:
    found = store.read("schema_steps")
    return [] if found is None else [r.step for r in found.orderBy("number").collect()]


def derive_all(store: Snapshots, kinds: list[tuple[str, Callable[[], DataFrame]]], watermark: str) -> dict[str, str]:
    """Runs the derivations in order and commits each under the watermark; one that is up to date is skipped, one that fails leaves its watermark unset and the others go on."""
    out = {}
    for name, make in kinds:
        try:
            out[name] = "derived" if store.commit_if_changed(name, make, watermark) else "unchanged"
        except Exception as e:  # noqa: BLE001 - the next run tries again
            out[name] = f"failed: {type(e).__name__}"
    return out


def all_paths(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project_id, path, known_as): each path under its present and all its former names; ``aliases``: project_id, old_path, new_path.

    One level of aliases is one rename; a chain is closed where aliases are written (``add_alias``).
    """
    own = paths.select("project_id", "path", F.col("path").alias("known_as"))
    former = paths.join(aliases.select("project_id", F.col("new_path").alias("path"), F.col("old_path").alias("known_as")), ["project_id", "path"])
    return own.unionByName(former).distinct()


def add_alias(aliases: DataFrame, renames: DataFrame) -> DataFrame:
    """Aliases after further renames (project_id, old_path, new_path): former names of a renamed file now lead to its new name."""
    step = renames.select("project_id", F.col("old_path").alias("new_path"), F.col("new_path").alias("further"))
    moved = aliases.join(step, ["project_id", "new_path"], "left").select("project_id", "old_path", F.coalesce("further", "new_path").alias("new_path"))
    return moved.unionByName(renames.select("project_id", "old_path", "new_path")).filter("old_path <> new_path").distinct()


def issues_of(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """(project_id, sha, issues): the ordered list of a commit's issues as tracker:issue, those it fixes first."""
    entry = F.struct((F.col("relation") != "FIXES").alias("later"), "tracker", "issue")
    listed = refs.groupBy("entity_id").agg(F.array_sort(F.collect_set(entry)).alias("list"))
    rows = commits.select("entity_id", "project_id", "sha").join(listed, "entity_id")
    return rows.select("project_id", "sha", F.transform("list", lambda x: F.concat(x["tracker"], F.lit(":"), x["issue"])).alias("issues"))


def latest_per_path(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """(project_id, path, sha): the last fix of every path, newest first, ties by sha."""
    fixes = touches.join(commits.filter("is_fix").select("entity_id", "sha", "authored_at"), "entity_id")
    order = Window.partitionBy("project_id", "path").orderBy(F.col("authored_at").desc_nulls_last(), "sha")
    return fixes.withColumn("n", F.row_number().over(order)).filter("n = 1").select("project_id", "path", "sha")


def resolve_mentions(mentions: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, kind, mention, target): names and paths that documents speak of, where exactly one symbol or file of the project has the name or ends in it.

    ``mentions``: doc_id, project_id, kind (identifier or path), mention. Endings are exploded keys, so both are equi-joins.
    """
    tails = F.array_distinct(F.array("name", F.regexp_replace("name", r"^.*::", "")))
    named = symbols.filter("name IS NOT NULL AND id IS NOT NULL").select("project_id", F.lit("identifier").alias("kind"), F.col("id").cast("bigint").alias("id"), F.explode(tails).alias("mention"))
    ends = F.expr("transform(sequence(1, size(split(path, '/'))), n -> substring_index(path, '/', -n))")
    placed = files.filter("path IS NOT NULL AND id IS NOT NULL").select("project_id", F.lit("path").alias("kind"), F.col("id").cast("bigint").alias("id"), F.explode(ends).alias("mention"))
    one = named.unionByName(placed).groupBy("project_id", "kind", "mention").agg(F.min("id").alias("target"), F.max("id").alias("last")).filter("target = last").drop("last")
    return mentions.join(one, ["project_id", "kind", "mention"]).select("doc_id", "kind", "mention", "target")
