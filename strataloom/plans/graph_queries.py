"""Queries over projects, files, symbols and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.functions.ranking import with_rank
from strataloom.operators import graph, identity
from strataloom.session import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NOT = ", ".join(f"'{w}'" for w in graph.NOT_CALLS)
EDGES = rf"""
b AS (SELECT project_id, id AS src, file_id, regexp_replace(name, '^.*::', '') AS own, regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS calls, regexp_extract_all(body, '\bnew\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS made FROM symbols WHERE body IS NOT NULL),
e AS (SELECT project_id, src, file_id, own, made, unnest(list_distinct(calls)) AS dst_name FROM b),
edges AS (SELECT project_id, src, file_id, dst_name, CASE WHEN list_contains(made, dst_name) THEN 'INSTANTIATES' ELSE 'CALLS' END AS relation FROM e WHERE dst_name <> own AND dst_name NOT IN ({_NOT})),
x AS (SELECT project_id, name AS k, min(id) AS d FROM symbols GROUP BY 1, 2),
t AS (SELECT project_id, regexp_replace(name, '^.*::', '') AS k, min(id) AS d FROM symbols WHERE contains(name, '::') GROUP BY 1, 2),
s AS (SELECT project_id, regexp_replace(name, '^.*\\', '') AS k, min(id) AS d FROM symbols GROUP BY 1, 2 HAVING count(*) = 1),
resolved AS (SELECT e.project_id, e.src, e.file_id, e.dst_name, e.relation, coalesce(x.d, t.d, y.d, s.d) AS dst FROM edges e
  LEFT JOIN x ON x.project_id = e.project_id AND x.k = e.dst_name LEFT JOIN t ON t.project_id = e.project_id AND t.k = e.dst_name
  LEFT JOIN x y ON y.project_id = e.project_id AND y.k = ltrim(e.dst_name, '\') LEFT JOIN s ON s.project_id = e.project_id AND s.k = regexp_replace(e.dst_name, '^.*\\', ''))
"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return graph.resolve_edges(graph.call_edges(symbols), symbols)


@query("""
SELECT p.id AS project_id, p.name, coalesce(f.n, 0) AS files, coalesce(s.n, 0) AS symbols, coalesce(c.n, 0) AS commits FROM projects p
LEFT JOIN (SELECT project_id, count(*) AS n FROM files GROUP BY 1) f ON f.project_id = p.id LEFT JOIN (SELECT project_id, count(*) AS n FROM symbols GROUP BY 1) s ON s.project_id = p.id
LEFT JOIN (SELECT project_id, count(DISTINCT sha) AS n FROM commits GROUP BY 1) c ON c.project_id = p.id""")
def list_projects(spark, d):
    out = table(spark, d, "projects").select(F.col("id").alias("project_id"), "name")
    for name, n in (("files", F.count("*")), ("symbols", F.count("*")), ("commits", F.countDistinct("sha"))):
        out = out.join(table(spark, d, name).groupBy("project_id").agg(n.alias(name)), "project_id", "left")
    return out.select("project_id", "name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files", "symbols", "commits")])


@query("""
SELECT project_id, dir, files, loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, dir) AS rank FROM
 (SELECT project_id, split_part(path, '/', 1) AS dir, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM files WHERE path IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 20""")
def overview_top_dirs(spark, d):
    rows = table(spark, d, "files").filter("path IS NOT NULL").groupBy("project_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return with_rank(rows, ["project_id"], F.col("files").desc(), F.col("dir"), keep=20)


@query("SELECT project_id, language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY 1, 2")
def overview_languages(spark, d):
    return table(spark, d, "files").groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


@query("WITH " + EDGES + "SELECT project_id, src, dst_name, relation FROM edges")
def call_edges(spark, d):
    return graph.call_edges(table(spark, d, "symbols")).drop("file_id")


@query("WITH " + EDGES + "SELECT project_id, src, dst_name, relation, dst FROM resolved")
def edge_resolution_4pass(spark, d):
    return _resolved(spark, d).select("project_id", "src", "dst_name", "relation", "dst")


@query("WITH " + EDGES + """, i AS (SELECT dst AS id, count(*) AS n FROM resolved WHERE dst IS NOT NULL GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM resolved GROUP BY 1),
h AS (SELECT s.project_id, s.id AS symbol_id, s.name, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM symbols s LEFT JOIN i USING (id) LEFT JOIN o USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY inbound DESC, symbol_id) AS rank FROM h) SELECT * FROM r WHERE rank <= 15""")
def overview_hubs(spark, d):
    rows = graph.hubs(_resolved(spark, d), table(spark, d, "symbols"))
    return with_rank(rows, ["project_id"], F.col("inbound").desc(), F.col("symbol_id"), keep=15)


@query("WITH " + EDGES + """, u AS (SELECT project_id, relation, dst_name, count(*) AS uses FROM edges GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY uses DESC, dst_name, relation) AS rank FROM u) SELECT * FROM r WHERE rank <= 25""")
def relation_usage(spark, d):
    rows = graph.call_edges(table(spark, d, "symbols")).groupBy("project_id", "relation", "dst_name").agg(F.count("*").alias("uses"))
    return with_rank(rows, ["project_id"], F.col("uses").desc(), F.col("dst_name"), F.col("relation"), keep=25)


_SIDE = """SELECT DISTINCT r.project_id, r.{here} AS symbol_id, r.relation, coalesce(s.name, {raw}) AS other, f.path AS other_path FROM resolved r
LEFT JOIN symbols s ON s.id = r.{there} LEFT JOIN files f ON f.id = s.file_id WHERE r.{here} IS NOT NULL"""


@query("WITH " + EDGES + _SIDE.format(here="dst", there="src", raw="'@file'"))
def callers(spark, d):
    return graph.neighbours(_resolved(spark, d), table(spark, d, "symbols"), table(spark, d, "files"), inbound=True)


@query("WITH " + EDGES + _SIDE.format(here="src", there="dst", raw="r.dst_name"))
def callees(spark, d):
    return graph.neighbours(_resolved(spark, d), table(spark, d, "symbols"), table(spark, d, "files"), inbound=False)


_NODES = "WITH RECURSIVE " + EDGES + """, l AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM resolved WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT dst, src FROM resolved WHERE dst IS NOT NULL AND src <> dst)),
seeds AS (SELECT project_id, min(src) AS seed FROM resolved WHERE dst IS NOT NULL GROUP BY 1),
g AS (SELECT seed, seed AS id, 0 AS depth FROM seeds UNION SELECT g.seed, l.b, g.depth + 1 FROM g JOIN l ON l.a = g.id WHERE g.depth < 2),
m AS (SELECT seed, id, min(depth) AS depth FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS n FROM m)"""


@query(_NODES + " SELECT seed, id, depth FROM r WHERE n <= 60")
def bfs_depth2(spark, d):
    return _subgraph(spark, d)[1]


def _subgraph(spark, d):
    """(resolved edges, the nodes within two hops of each project's first calling symbol)."""
    resolved = cut(_resolved(spark, d))
    seeds = resolved.filter("dst IS NOT NULL").groupBy("project_id").agg(F.min("src").alias("seed")).select("seed")
    return resolved, graph.subgraph(resolved, seeds, 2)


@query(_NODES + """, n AS (SELECT seed, id FROM r WHERE n <= 60)
SELECT DISTINCT a.seed, e.src, e.dst, e.relation, e.dst_name, b.id IS NOT NULL AS inside FROM n a JOIN resolved e ON e.src = a.id LEFT JOIN n b ON b.seed = a.seed AND b.id = e.dst""")
def subgraph_edges(spark, d):
    resolved, nodes = _subgraph(spark, d)
    return graph.subgraph_edges(resolved, nodes)



@query("""SELECT f.id AS file_id, f.path, row_number() OVER (PARTITION BY f.id ORDER BY s.start_line NULLS LAST, s.id) AS ord, s.id AS symbol_id, s.name, s.kind, s.signature, s.start_line, s.end_line FROM symbols s JOIN files f ON f.id = s.file_id""")
def file_outline(spark, d):
    return graph.outline(table(spark, d, "symbols"), table(spark, d, "files"))


@query("""WITH k AS (SELECT project_id, regexp_replace(name, '^.*::', '') AS wanted, min(id) AS seed FROM symbols GROUP BY 1, 2)
SELECT k.project_id, k.wanted, count(*) AS matches, min(s.id) AS first_id, count(*) FILTER (WHERE s.name = k.wanted) AS exact FROM k JOIN symbols s ON s.project_id = k.project_id AND (s.name = k.wanted OR ends_with(s.name, '::' || k.wanted)) GROUP BY 1, 2""")
def suffix_name_match(spark, d):
    s = table(spark, d, "symbols").filter("name IS NOT NULL")
    wanted = s.select("project_id", F.regexp_replace("name", r"^.*::", "").alias("wanted")).distinct()
    keyed = s.select("project_id", "id", "name", F.explode(graph.suffixes(F.col("name"))).alias("wanted"))
    return keyed.join(wanted, ["project_id", "wanted"]).groupBy("project_id", "wanted").agg(F.count("*").alias("matches"), F.min("id").alias("first_id"), F.count_if(F.col("name") == F.col("wanted")).alias("exact"))


@query("SELECT project_id, regexp_replace(name, '^.*::', '') AS short, min(id) AS id FROM symbols GROUP BY 1, 2 HAVING count(*) = 1")
def resolve_unique_only(spark, d):
    rows = table(spark, d, "symbols").filter("name IS NOT NULL").groupBy("project_id", F.regexp_replace("name", r"^.*::", "").alias("short")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return rows.filter("n = 1").drop("n")


_GET = """WITH w AS (SELECT project_id, max(name) AS wanted FROM symbols WHERE kind = 'function' GROUP BY 1),
m AS (SELECT s.project_id, s.id AS symbol_id, s.name, f.path, s.start_line, s.body, row_number() OVER (PARTITION BY s.project_id ORDER BY (s.name = w.wanted) DESC, s.id) AS rank FROM symbols s JOIN w ON w.project_id = s.project_id AND (s.name = w.wanted OR ends_with(s.name, '::' || w.wanted)) JOIN files f ON f.id = s.file_id)
SELECT project_id, symbol_id, name, path, start_line, rank, CASE WHEN rank = 1 THEN body END AS body FROM m WHERE rank <= 5"""


@query(_GET)
def get_symbol(spark, d):
    s = table(spark, d, "symbols").filter("name IS NOT NULL")
    wanted = s.filter("kind = 'function'").groupBy("project_id").agg(F.max("name").alias("wanted"))
    hit = s.withColumn("wanted", F.explode(graph.suffixes(F.col("name")))).join(wanted, ["project_id", "wanted"])
    rows = hit.join(table(spark, d, "files").select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("symbol_id", F.col("id"))
    ranked = with_rank(rows, ["project_id"], (F.col("name") == F.col("wanted")).desc(), F.col("symbol_id"), keep=5)
    return ranked.select("project_id", "symbol_id", "name", "path", "start_line", "rank", F.when(F.col("rank") == 1, F.col("body")).alias("body"))


_KEYS = """k AS (SELECT s.id, s.project_id, f.path, s.kind, s.name, row_number() OVER (PARTITION BY s.file_id, s.kind, s.name ORDER BY s.start_line NULLS LAST, s.id) AS n, trim(regexp_replace(s.body, '\\s+', ' ', 'g')) AS bare FROM symbols s JOIN files f ON f.id = s.file_id),
keys AS (SELECT id, project_id, path, kind, name, path || '#' || kind || ':' || name || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS symbol_key, CASE WHEN length(bare) >= 64 THEN sha256(bare) END AS fingerprint FROM k)"""


@query("WITH " + _KEYS + " SELECT * FROM keys")
def dup_numbering_keys(spark, d):
    return identity.symbol_keys(table(spark, d, "symbols"), table(spark, d, "files"))


# Two snapshots for the identity queries: in the second one every file with an even id moved to another folder.
_MOVED = _KEYS.replace("keys AS", "old_keys AS") + """, moved AS (SELECT k.id, k.project_id, CASE WHEN f.id % 2 = 0 THEN 'moved/' || f.path ELSE f.path END AS path, s.kind, s.name, row_number() OVER (PARTITION BY s.file_id, s.kind, s.name ORDER BY s.start_line NULLS LAST, s.id) AS n, k.bare FROM k JOIN symbols s ON s.id = k.id JOIN files f ON f.id = s.file_id),
new_keys AS (SELECT id, project_id, path, kind, name, path || '#' || kind || ':' || name || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS symbol_key, CASE WHEN length(bare) >= 64 THEN sha256(bare) END AS fingerprint FROM moved),
retired AS (SELECT o.* FROM old_keys o ANTI JOIN new_keys n ON n.project_id = o.project_id AND n.symbol_key = o.symbol_key), appeared AS (SELECT n.* FROM new_keys n ANTI JOIN old_keys o ON n.project_id = o.project_id AND n.symbol_key = o.symbol_key)"""


def _snapshots(spark, d):
    files, symbols = table(spark, d, "files"), table(spark, d, "symbols")
    old = identity.symbol_keys(symbols, files)
    new = identity.symbol_keys(symbols, files.withColumn("path", F.when(F.col("id") % 2 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))))
    return old, new


@query("WITH " + _MOVED + """, f1 AS (SELECT project_id, fingerprint, min(symbol_key) AS old_key FROM retired WHERE fingerprint IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), f2 AS (SELECT project_id, fingerprint, min(symbol_key) AS new_key FROM appeared WHERE fingerprint IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
p1 AS (SELECT f1.project_id, old_key, new_key FROM f1 JOIN f2 USING (project_id, fingerprint)),
r2 AS (SELECT project_id, kind, name, min(symbol_key) AS old_key FROM retired r WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.project_id = r.project_id AND p1.old_key = r.symbol_key) GROUP BY 1, 2, 3 HAVING count(*) = 1),
a2 AS (SELECT project_id, kind, name, min(symbol_key) AS new_key FROM appeared r WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.project_id = r.project_id AND p1.new_key = r.symbol_key) GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT project_id, old_key, new_key, 'fingerprint' AS how FROM p1 UNION ALL SELECT r2.project_id, old_key, new_key, 'name' FROM r2 JOIN a2 USING (project_id, kind, name)""")
def rename_match_2pass(spark, d):
    old, new = _snapshots(spark, d)
    retired = old.join(new.select("project_id", "symbol_key"), ["project_id", "symbol_key"], "left_anti")
    appeared = new.join(old.select("project_id", "symbol_key"), ["project_id", "symbol_key"], "left_anti")
    return identity.match_renames(retired, appeared)


@query("WITH " + _MOVED + """, o AS (SELECT DISTINCT project_id, symbol_key, name FROM old_keys), n AS (SELECT DISTINCT project_id, symbol_key, name FROM new_keys)
SELECT project_id, symbol_key AS natural_key, coalesce(n.name, o.name) AS title, CASE WHEN n.symbol_key IS NULL THEN TIMESTAMP '2025-01-01' END AS deleted_at,
 CASE WHEN n.symbol_key IS NULL THEN 'retired' WHEN o.symbol_key IS NULL THEN 'new' ELSE 'kept' END AS state FROM o FULL JOIN n USING (project_id, symbol_key)""")
def entity_merge_tombstone(spark, d):
    old, new = _snapshots(spark, d)
    entities = old.select("project_id", F.col("symbol_key").alias("natural_key"), F.xxhash64("project_id", "symbol_key").alias("entity_id"), F.col("name").alias("title"), F.lit(None).cast("timestamp_ntz").alias("deleted_at")).distinct()
    present = new.select("project_id", F.col("symbol_key").alias("natural_key"), F.col("name").alias("title")).distinct()
    return identity.reconcile(entities, present, F.lit("2025-01-01").cast("timestamp_ntz")).drop("entity_id")


@query("SELECT id AS file_id, coalesce(NOT (hash IS NOT DISTINCT FROM sha256(content)), true) AS changed FROM files WHERE content IS NOT NULL")
def content_hash_skip(spark, d):
    f = table(spark, d, "files").filter("content IS NOT NULL")
    return f.select(F.col("id").alias("file_id"), (~F.col("hash").eqNullSafe(F.sha2("content", 256))).alias("changed"))


@query("""WITH last AS (SELECT project_id, path, lower(hash) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY observed_at DESC, row_id DESC) AS r FROM file_scans WHERE error IS NULL AND NOT coalesce(is_deleted, false)) WHERE r = 1)
SELECT project_id, path, CASE WHEN f.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT project_id, path, hash, path AS p FROM files) f FULL JOIN (SELECT *, path AS p FROM last) l USING (project_id, path) WHERE f.p IS NULL OR l.p IS NULL OR f.hash IS DISTINCT FROM l.hash""".replace("f.path IS NULL", "f.p IS NULL").replace("l.path IS NULL", "l.p IS NULL"))
def changed_files_manifest(spark, d):
    from strataloom.operators.store import changed_files

    w = Window.partitionBy("project_id", "path").orderBy(F.col("observed_at").desc(), F.col("row_id").desc())
    scans = table(spark, d, "file_scans").filter("error IS NULL AND NOT coalesce(is_deleted, false)").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return changed_files(table(spark, d, "files"), scans.select("project_id", "path", F.lower("hash").alias("hash")))


@query("""SELECT dir, root FROM (SELECT f.dir, p.root_path AS root, row_number() OVER (PARTITION BY f.dir ORDER BY length(p.root_path) DESC) AS r FROM (SELECT DISTINCT p.root_path || '/' || split_part(f.path, '/', 1) AS dir, p.org_id FROM files f JOIN projects p ON p.id = f.project_id) f JOIN projects p ON p.org_id = f.org_id AND (f.dir = p.root_path OR starts_with(f.dir, p.root_path || '/'))) WHERE r = 1""")
def deepest_root(spark, d):
    p = table(spark, d, "projects").select("id", "org_id", F.col("root_path").alias("root"))
    dirs = table(spark, d, "files").join(p.withColumnRenamed("id", "project_id"), "project_id").select(F.concat("root", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1))).alias("dir"), "org_id").distinct()
    return graph.hierarchy_depth(dirs.join(p.select("org_id", "root"), "org_id"))
