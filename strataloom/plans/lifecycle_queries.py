"""Queries over modules, deletions, aliases, issues and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.functions import documents as docs
from strataloom.functions import messages
from strataloom.functions.text import module_path
from strataloom.operators import history, lifecycle, search
from strataloom.plans.evaluation import sample_commits
from strataloom.plans.history_queries import SQL as HISTORY_SQL
from strataloom.plans.history_queries import U
from strataloom.plans.text_queries import MENTIONS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MODULE = "CASE WHEN contains({0}, '/') THEN array_to_string(list_slice(string_split({0}, '/'), 1, least(2, len(string_split({0}, '/')) - 1)), '/') ELSE '.' END"


@query(f"""WITH n AS (SELECT project_id, {_MODULE.format('path')} AS module, count(*) AS files FROM files WHERE path IS NOT NULL GROUP BY 1, 2), o AS (SELECT DISTINCT project_id, {_MODULE.format('path')} AS module FROM commit_files WHERE path <> '')
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.module, o.module) AS module, CASE WHEN o.module IS NOT NULL THEN 'kept: ' || o.module END AS title, coalesce(n.files, 0) AS files, CASE WHEN o.module IS NULL THEN 'added' WHEN n.module IS NULL THEN 'pruned' ELSE 'kept' END AS change
FROM n FULL OUTER JOIN o ON n.project_id = o.project_id AND n.module = o.module""")
def module_upsert_prune(spark, d):
    """The modules of the past, as commits touched them, brought up to the files of today."""
    past = table(spark, d, "commit_files").filter("path <> ''").select("project_id", module_path(F.col("path"), 2).alias("module")).distinct()
    old = past.filter("project_id IS NOT NULL").select(F.xxhash64("project_id", "module").alias("module_id"), "project_id", "module", F.concat(F.lit("kept: "), "module").alias("title"))
    return lifecycle.upsert_modules(old, lifecycle.module_members(table(spark, d, "files"))).drop("module_id")


_OWNED = ("files", "symbols", "commits", "commit_files", "chunks", "documents", "cochange")


@query("WITH g AS (SELECT min(id) AS id FROM projects) " + " UNION ALL ".join([f"SELECT '{t}' AS name, count(*) AS n FROM {t} WHERE project_id IS DISTINCT FROM (SELECT id FROM g)" for t in _OWNED] + ["SELECT 'projects', count(*) FROM projects WHERE id IS DISTINCT FROM (SELECT id FROM g)", "SELECT 'usage', count(*) FROM search_queries"]))
def project_deletion(spark, d):
    """Rows left in each table when the first project is deleted; what was asked about it stays, without its project."""
    gone = table(spark, d, "projects").agg(F.min("id")).first()[0]
    held = {t: table(spark, d, t) for t in (*_OWNED, "projects")} | {"usage": table(spark, d, "search_queries").select("query_id", "project_id")}
    out = None
    for name, df in lifecycle.without_project(held, gone or 0).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {U}, x AS (SELECT u.project_id, u.sha, f.path, u.authored_at FROM u JOIN commit_files f ON f.commit_entity_id = u.entity_id WHERE u.is_fix AND f.path <> '')
SELECT DISTINCT ON (project_id, path) project_id, path, sha FROM x ORDER BY project_id, path, authored_at DESC NULLS LAST, sha""")
def last_fix_per_path(spark, d):
    ours = history.unique_commits(table(spark, d, "commits"))
    touches = history.path_touches(ours.select("entity_id"), table(spark, d, "commit_files"))
    place = ours.select("entity_id", "project_id")
    return lifecycle.latest_per_path(ours, touches.select("entity_id", "path").distinct().join(place, "entity_id"))


@query("WITH r AS (" + HISTORY_SQL["issue_refs"] + """), l AS (SELECT entity_id, list(tracker || ':' || issue ORDER BY relation <> 'FIXES', tracker, issue) AS issues FROM r GROUP BY 1)
SELECT c.project_id, c.sha, array_to_string(l.issues, ' ') AS issues FROM commits c JOIN l USING (entity_id)""")
def commit_issues(spark, d):
    """The issues of every commit, those it fixes first."""
    c = table(spark, d, "commits")
    refs = messages.issue_refs(c.withColumn("message", F.concat_ws("\n", "subject", "body")), "entity_id", "message")
    return lifecycle.issues_of(c, refs).withColumn("issues", F.array_join("issues", " "))


@query(f"""WITH {MENTIONS}, k AS (SELECT project_id, 'identifier' AS kind, CAST(id AS BIGINT) AS id, unnest(list_distinct([name, regexp_replace(name, '^.*::', '')])) AS key FROM symbols WHERE name IS NOT NULL
 UNION ALL SELECT project_id, 'path', id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) FROM files WHERE path IS NOT NULL),
o AS (SELECT project_id, kind, key, min(id) AS target FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1)
SELECT m.doc_id, m.kind, m.mention, o.target FROM mentions m JOIN o ON o.project_id = m.project_id AND o.kind = m.kind AND o.key = m.mention""")
def mention_resolution(spark, d):
    """Names and paths in documents resolved to the one symbol or file of the project that bears them."""
    docs_ = table(spark, d, "documents")
    said = docs.mention_rows(docs_).join(docs_.select("doc_id", "project_id"), "doc_id")
    return lifecycle.resolve_mentions(said, table(spark, d, "symbols"), table(spark, d, "files"))


@query("SELECT c.id AS chunk_id, c.project_id, d.doc_type, d.title, c.ord FROM chunks c JOIN documents d ON d.doc_id = c.entity_id")
def chunk_documents(spark, d):
    rows = search.live_chunks(table(spark, d, "chunks"), table(spark, d, "documents"))
    return rows.select(F.col("id").alias("chunk_id"), "project_id", "doc_type", "title", "ord")


@query("WITH e AS (" + HISTORY_SQL["eval_sample_stride"] + f"""), {U}
SELECT DISTINCT e.project_id, e.sha, f.path FROM e JOIN u USING (project_id, sha) JOIN commit_files f ON f.commit_entity_id = u.entity_id JOIN files x ON x.project_id = e.project_id AND x.path = f.path WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = x.id)""")
def eval_answers(spark, d):
    """The answers of the replayed commits: paths that are files with symbols today."""
    commits, touched = table(spark, d, "commits"), table(spark, d, "commit_files")
    ours = history.unique_commits(commits).select("entity_id", "project_id", "sha")
    paths = history.path_touches(ours.select("entity_id"), touched).select("entity_id", "path").distinct()
    wanted = sample_commits(commits, touched).select("project_id", "sha").join(ours, ["project_id", "sha"]).join(paths, "entity_id").select("project_id", "sha", "path")
    with_symbols = table(spark, d, "files").join(table(spark, d, "symbols").select(F.col("file_id").alias("id")), "id", "left_semi").select("project_id", "path")
    return wanted.join(with_symbols, ["project_id", "path"], "left_semi").distinct()


@query("""WITH a AS (SELECT project_id, min(path) AS old_path, max(path) AS new_path FROM files GROUP BY 1, language HAVING min(path) <> max(path)), b AS (SELECT project_id, new_path AS old_path, new_path || '.moved' AS new_path FROM a),
z AS (SELECT DISTINCT * FROM (SELECT a.project_id, a.old_path, coalesce(b.new_path, a.new_path) AS new_path FROM a LEFT JOIN b ON b.project_id = a.project_id AND b.old_path = a.new_path UNION ALL SELECT * FROM b))
SELECT DISTINCT * FROM (SELECT project_id, new_path AS path, new_path AS known_as FROM b UNION ALL SELECT b.project_id, b.new_path, z.old_path FROM b JOIN z ON z.project_id = b.project_id AND z.new_path = b.new_path)""")
def former_paths(spark, d):
    """Two renames in a row: a file is known under its present and both former names."""
    first = table(spark, d, "files").groupBy("project_id", "language").agg(F.min("path").alias("old_path"), F.max("path").alias("new_path")).filter("old_path <> new_path").drop("language")
    second = first.select("project_id", F.col("new_path").alias("old_path"), F.concat("new_path", F.lit(".moved")).alias("new_path"))
    aliases = lifecycle.add_alias(lifecycle.add_alias(first.limit(0), first), second)
    return lifecycle.all_paths(second.select("project_id", F.col("new_path").alias("path")), aliases)
