"""Queries over composed contexts, rules, decisions, parsing and streaming."""

from __future__ import annotations


from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.functions import messages
from strataloom.operators import compose, graph, history, search
from strataloom.plans.graph_queries import EDGES
from strataloom.plans.text_queries import _index, _lexical
from strataloom.session import shared_dir
from strataloom.sources import code_parser, decisions

QUERIES, SQL = {}, {}
TASK = 'Fix the "stale cache" retry in `src/core` and src/main/ when resolve_hidden_tag or TruncatedInvoiceView::collect_rule throws, see README.md and/or the guide'
GLOBS = [(1, "never edit an applied migration", "src/**", "critical", "active", 0.9), (2, "prefer small modules", None, "low", "active", 0.5), (3, "always test the tools", "tools/*.py", "high", "active", 0.8), (4, "old rule", "lib/**", "medium", "rejected", 0.7), (5, "never log secrets", "app/**/*.php", "high", "active", 0.65)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RULE_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in GLOBS)


@query(f"""WITH r AS (SELECT * FROM (VALUES {_RULE_VALUES}) t(rule_id, statement, scope, severity, state, confidence)), m AS (SELECT f.project_id, r.rule_id, r.severity, r.confidence, count(*) AS files FROM r JOIN files f ON r.state = 'active' AND (r.scope IS NULL OR f.path = r.scope OR CASE r.scope WHEN 'src/**' THEN regexp_full_match(f.path, 'src/.*') WHEN 'tools/*.py' THEN regexp_full_match(f.path, 'tools/[^/]*\\.py') ELSE regexp_full_match(f.path, 'app/(.*/)?[^/]*\\.php') END) GROUP BY ALL)
SELECT project_id, rule_id, files, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence DESC, rule_id) AS rank FROM m""")
def scope_glob_rules(spark, d):
    """Which active rules apply to each project's files; the globs are compiled once each and tested on the path column."""
    from strataloom.functions.ranking import with_rank
    from strataloom.functions.text import path_in_scope

    files = table(spark, d, "files").select("project_id", "path")
    out = None
    for rule, _, scope, severity, state, confidence in GLOBS:
        if state == "active":
            level = {"critical": 0, "high": 1, "medium": 2}.get(severity, 3)
            one = files.filter(path_in_scope(F.col("path"), scope)).groupBy("project_id").agg(F.count("*").alias("files")).select("project_id", F.lit(rule).alias("rule_id"), "files", F.lit(level).alias("level"), F.lit(confidence).alias("confidence"))
            out = one if out is None else out.unionByName(one)
    return with_rank(out, ["project_id"], F.col("level"), F.col("confidence").desc(), F.col("rule_id")).select("project_id", "rule_id", "files", "rank")


_HINTS = [("path", "src/core"), ("path", "src/main"), ("path", "README.md"), ("symbol", "resolve_hidden_tag"), ("symbol", "TruncatedInvoiceView"), ("symbol", "collect_rule")]
_HINT_VALUES = ", ".join(f"('{k}', '{h}')" for k, h in _HINTS)


@query(f"""WITH h AS (SELECT * FROM (VALUES {_HINT_VALUES}) t(kind, hint)), m AS (SELECT h.kind, h.hint, f.project_id, f.path AS match FROM h JOIN files f ON h.kind = 'path' AND (f.path = h.hint OR starts_with(f.path, h.hint || '/'))
UNION ALL SELECT DISTINCT h.kind, h.hint, s.project_id, s.name FROM h JOIN symbols s ON h.kind = 'symbol' AND (s.name = h.hint OR regexp_replace(s.name, '^.*::', '') = h.hint)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind, hint, project_id ORDER BY length(match), match) AS INTEGER) AS rank FROM m)
SELECT * FROM r WHERE rank <= 8 UNION ALL SELECT kind, hint, NULL, NULL, NULL FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.kind = h.kind AND m.hint = h.hint)""")
def task_hints(spark, d):
    task = compose.parse_task(TASK)
    return compose.resolve_hints(spark, task, table(spark, d, "files"), table(spark, d, "symbols"))


@query(f"""WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sha ORDER BY entity_id) AS _r FROM commits) WHERE _r = 1), p AS (SELECT DISTINCT path FROM files WHERE starts_with(path, 'src/')),
r AS (SELECT rule_id, statement, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence DESC, rule_id) AS rank FROM (VALUES {_RULE_VALUES}) t(rule_id, statement, scope, severity, state, confidence) WHERE state = 'active' AND (scope IS NULL OR scope = 'src/**')),
fx AS (SELECT DISTINCT u.sha, u.subject, u.authored_at FROM u JOIN commit_files f ON f.commit_entity_id = u.entity_id WHERE u.is_fix AND f.path IN (SELECT path FROM p)), fr AS (SELECT *, row_number() OVER (ORDER BY authored_at DESC NULLS LAST, sha) AS rank FROM fx)
SELECT 'rule' AS kind, CAST(rule_id AS VARCHAR) AS ref, statement AS text, rank FROM r UNION ALL SELECT 'fix', sha, subject, rank FROM fr WHERE rank <= 5 UNION ALL SELECT 'memory', '1', 'keep the cache small', 1""")
def review_context(spark, d):
    rules = spark.createDataFrame(GLOBS, "rule_id int, statement string, scope string, severity string, state string, confidence double")
    memories = spark.createDataFrame([(1, "keep the cache small", None, True, None), (2, "about tools", "tools/**", False, None), (3, "old", None, True, None), (4, "new", "none/**", False, 3)], "memory_id bigint, content string, scope string, pinned boolean, supersedes bigint")
    paths = table(spark, d, "files").filter(F.startswith("path", F.lit("src/"))).select("path").distinct()
    fixes = history.path_touches(history.unique_commits(table(spark, d, "commits")).filter("is_fix").select("entity_id", "sha", "subject", "authored_at"), table(spark, d, "commit_files"))
    return compose.review_context(rules, memories, fixes.select("sha", "subject", "authored_at", "path"), paths)


def _graph() -> dict:
    g = decisions.new_graph("Cache layer")
    return decisions.apply(g, [
        {"op": "add_node", "id": "store", "title": "Where to keep it"}, {"op": "add_alternative", "id": "store", "value": "memory"}, {"op": "add_alternative", "id": "store", "value": "disk"}, {"op": "select_answer", "id": "store", "value": "disk"},
        {"op": "add_node", "id": "ttl", "title": "How long", "parent": "store"}, {"op": "set_confidence", "id": "ttl", "value": 0.8}, {"op": "set_review", "id": "ttl", "value": "concern"}, {"op": "set_risk", "id": "ttl", "value": "high"}, {"op": "set_affected_files", "id": "ttl", "value": ["src/a.py", "src/b.py"]}, {"op": "set_affected_files", "id": "store", "value": ["src/a.py"]},
    ])


@query("SELECT 'cache-layer' AS slug, CAST(3 AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS decided, CAST(0 AS BIGINT) AS approved, CAST(1 AS BIGINT) AS concerns, round((0.5 * 1 + 0.5 * 3 + 0.8 * 1) / 5, 6) AS confidence")
def decision_summary(spark, d):
    return decisions.summary(decisions.node_rows(spark, [_graph()]))


@query("SELECT * FROM (VALUES ('cache-layer', 'src/a.py', CAST(2 AS BIGINT), 'high'), ('cache-layer', 'src/b.py', CAST(1 AS BIGINT), 'high')) t(slug, file, nodes, risk)")
def decision_file_impact(spark, d):
    return decisions.file_impact(decisions.node_rows(spark, [_graph()]))


_COST = "CAST(ceil(length(coalesce(title, '')) / 4.0) + ceil(length(coalesce(snippet, '')) / 4.0) + ceil(length(coalesce(ref, '')) / 4.0) + 4 AS BIGINT)"
_WORDS = "handler cache".split()
_LISTS = {"code": ("si", "sy"), "doc": ("ci", "ch"), "memory": ("mi", "me")}


@query(f"""WITH RECURSIVE {EDGES}, words AS (SELECT id AS query_id, id AS project_id, unnest({_WORDS}) AS token, {len(_WORDS)} AS need FROM projects),
sy AS (SELECT *, 'code:' || id AS key FROM symbols), ch AS (SELECT c.*, 'doc:' || c.id AS key FROM chunks c JOIN documents d ON d.doc_id = c.entity_id), me AS (SELECT project_id, 'memory:' || doc_id AS key, text AS content FROM documents WHERE doc_type = 'note'),
{_index('si', 'sy', 'key', {"name": 1.0, "doc": 0.4, "body": 0.2})}, {_index('ci', 'ch', 'key', {"heading_path": 1.0, "content": 0.4})}, {_index('mi', 'me', 'key', {"content": 1.0})},
{_lexical('l1', 'si', 20)}, {_lexical('l2', 'ci', 20)}, {_lexical('l3', 'mi', 20)},
hits AS (SELECT sy.project_id, sy.id, l1.rank, l1.k AS key, sy.name, sy.signature, left(sy.body, 600) AS text FROM l1 JOIN sy ON sy.key = l1.k),
links AS (SELECT src AS a, dst AS b FROM resolved WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT dst, src FROM resolved WHERE dst IS NOT NULL AND src <> dst),
seeds AS (SELECT id AS a, rank FROM hits WHERE rank <= 3), near AS (SELECT b AS id, min(rank) AS r FROM links JOIN seeds USING (a) WHERE b NOT IN (SELECT a FROM seeds) GROUP BY 1),
gr AS (SELECT s.project_id, row_number() OVER (PARTITION BY s.project_id ORDER BY n.r, s.key) AS rank, s.key, s.name, s.signature FROM near n JOIN sy s USING (id)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sha ORDER BY entity_id) AS _r FROM commits) WHERE _r = 1 AND is_fix AND sha IS NOT NULL),
fx AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY authored_at DESC NULLS LAST, sha) AS rank FROM u),
items AS (SELECT project_id, 'code' AS channel, rank, key, 'code' AS type, name AS title, signature AS ref, text AS snippet FROM hits UNION ALL SELECT ch.project_id, 'doc', rank, k, 'doc', heading_path, NULL, left(content, 600) FROM l2 JOIN ch ON ch.key = k
 UNION ALL SELECT me.project_id, 'memory', rank, k, 'memory', left(content, 80), NULL, left(content, 400) FROM l3 JOIN me ON me.key = k UNION ALL SELECT project_id, 'history', rank, 'commit:' || sha, 'commit', subject, short_sha, NULL FROM fx WHERE rank <= 20
 UNION ALL SELECT project_id, 'graph', rank, key, 'graph', name, signature, NULL FROM gr WHERE rank <= 20),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY CASE WHEN snippet IS NULL THEN 1 ELSE 0 END, channel, rank) AS n FROM items) WHERE n = 1),
fu AS (SELECT project_id, key, round(sum(CASE channel WHEN 'code' THEN 1.0 WHEN 'doc' THEN 0.8 WHEN 'memory' THEN 0.7 WHEN 'history' THEN 0.6 ELSE 0.5 END / (60 + rank)), 5) AS score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM items GROUP BY 1, 2),
ru AS (SELECT * FROM (VALUES {_RULE_VALUES}) t(rule_id, statement, scope, severity, state, confidence)),
rm AS (SELECT DISTINCT f.project_id, r.rule_id, r.statement, r.severity, r.confidence FROM ru r JOIN files f ON r.state = 'active' AND (r.scope IS NULL OR CASE r.scope WHEN 'src/**' THEN regexp_full_match(f.path, 'src/.*') WHEN 'tools/*.py' THEN regexp_full_match(f.path, 'tools/[^/]*\\.py') ELSE regexp_full_match(f.path, 'app/(.*/)?[^/]*\\.php') END)),
al AS (SELECT f.project_id, f.key, b.type, b.title, b.ref, b.snippet, f.score, f.channels, false AS pinned, row_number() OVER (PARTITION BY f.project_id ORDER BY f.score DESC, f.key) AS rank FROM fu f JOIN best b USING (project_id, key)
 UNION ALL SELECT project_id, 'rule:' || rule_id, 'rule', statement, NULL, NULL, NULL, 'rules', true, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence DESC, rule_id) FROM rm),
l AS (SELECT *, {_COST} AS cost, row_number() OVER (PARTITION BY project_id ORDER BY NOT pinned, rank, key) AS n FROM al),
p AS (SELECT project_id, key, n, pinned OR cost <= 2000 AS taken, CASE WHEN pinned OR cost <= 2000 THEN cost ELSE 0 END AS used FROM l WHERE n = 1 UNION ALL SELECT l.project_id, l.key, l.n, l.pinned OR p.used + l.cost <= 2000, CASE WHEN l.pinned OR p.used + l.cost <= 2000 THEN p.used + l.cost ELSE p.used END FROM p JOIN l ON l.project_id = p.project_id AND l.n = p.n + 1)
SELECT l.project_id, l.key, l.type, l.title, l.score, l.channels, p.taken, p.used AS tokens_after FROM l JOIN p USING (project_id, key)""")
def compose_context(spark, d):
    """The context of one task for every project: five channels fused, the project's rules pinned, within 2000 tokens. Notes stand for memories."""
    tasks = table(spark, d, "projects").select(F.col("id").alias("query_id"), F.col("id").alias("project_id"), F.lit(" ".join(_WORDS)).alias("query_text"))
    symbols, docs_ = table(spark, d, "symbols"), table(spark, d, "documents")
    memories = docs_.filter("doc_type = 'note'").select(F.col("doc_id").alias("memory_id"), "project_id", F.col("text").alias("content"), F.lit(None).cast("bigint").alias("supersedes"))
    fixes = history.unique_commits(table(spark, d, "commits")).filter("is_fix").select("project_id", "sha", "short_sha", "subject", "authored_at")
    resolved = graph.resolve_edges(graph.call_edges(symbols), symbols)
    channels = compose.channel_items(tasks, symbols, search.live_chunks(table(spark, d, "chunks"), docs_.select("doc_id", F.lit(None).cast("string").alias("title"), "doc_type")).drop("title", "doc_type"), memories, fixes, resolved)
    said = spark.createDataFrame([(r[0], r[1]) for r in GLOBS], "rule_id int, statement string")
    rules = scope_glob_rules(spark, d).join(said, "rule_id").select("project_id", "rule_id", "statement", "rank")
    out = compose.compose(compose.union_channels(channels), rules, 2000, ["project_id"])
    return out.select("project_id", "key", "type", "title", "score", F.array_join("channels", ",").alias("channels"), "taken", "tokens_after")


@query()
def parse_symbols(spark, d):
    """Symbols read from the files' own text."""
    return code_parser.symbol_rows(code_parser.parse_files(table(spark, d, "files")))


@query()
def parse_relations(spark, d):
    return code_parser.relation_rows(code_parser.parse_files(table(spark, d, "files")))


@query("""SELECT project_id, sha, max(subject) AS subject, bool_or(is_fix) AS is_fix FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sha ORDER BY entity_id DESC) AS r FROM commits) WHERE r = 1 GROUP BY 1, 2""")
def streaming_ingest_converges(spark, d):
    """Commits replayed as a stream in three batches, read twice; the snapshot is that of one batch."""
    import uuid

    from strataloom.operators.store import Snapshots
    from strataloom.streaming.ingest import ingest

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = table(spark, d, "commits").select("project_id", "sha", "entity_id", "subject", "is_fix")
    for k in range(2):
        rows.repartition(3, "sha").write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/feed")
        ingest(stream, spark, f"{root}/state", "commits", ["project_id", "sha"], "entity_id", f"{root}/checkpoint").awaitTermination()
    return Snapshots(spark, f"{root}/state").read("commits").select("project_id", "sha", "subject", "is_fix")


_CASES = [
    ("fix: handle null", True, False), ("Fix crash on start", True, False), ("feat: assemble past fixes", False, False), ("Trac Lam - fix: typo", True, False), ("ABC-12 fixed the login", True, False), ("refactor: fix naming", False, False), ("Revert \"add cache\"", False, True), ("hotfix(api): retry", True, False), ("docs: prefix rules", False, False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(f).lower()}, {str(r).lower()})" for s, f, r in _CASES) + ") t(subject, fix, revert)")
def classify_truth_table(spark, d):
    rows = spark.createDataFrame([(s,) for s, _, _ in _CASES], "subject string")
    return rows.select("subject", messages.is_fix(F.col("subject")).alias("fix"), messages.is_revert(F.col("subject"), F.lit(None).cast("string")).alias("revert"))


_MESSAGE = "Add cache\n\nFixes #12 and see #13, PROJ-77, UTF-8\nhttps://github.com/a/b/issues/14\nCo-authored-by: Ann Lee <ANN@x.example>\nCo-authored-by: Ann <ann@x.example>\nCo-authored-by: Bo <bo@x.example>"


@query("SELECT * FROM (VALUES (1, 'ann@x.example', 'Ann Lee'), (1, 'bo@x.example', 'Bo')) t(id, email, name)")
def coauthors(spark, d):
    return messages.co_authors(spark.createDataFrame([(1, _MESSAGE)], "id int, m string"), "id", "m")


@query("SELECT * FROM (VALUES (1, 'github', '12', 'FIXES', NULL), (1, 'github', '13', 'REFERENCES', NULL), (1, 'github', '14', 'REFERENCES', 'https://github.com/a/b/issues/14'), (1, 'jira', 'PROJ-77', 'REFERENCES', NULL)) t(id, tracker, issue, relation, url)")
def issue_truth_table(spark, d):
    return messages.issue_refs(spark.createDataFrame([(1, _MESSAGE)], "id int, m string"), "id", "m")


@query("""SELECT table_name, rows FROM (SELECT 'projects' AS table_name, count(*) AS rows FROM projects UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'chunks', count(*) FROM chunks)""")
def table_counts(spark, d):
    out = None
    for name in ("projects", "files", "symbols", "commits", "chunks"):
        one = table(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, project_id, path FROM files ORDER BY id DESC LIMIT 20")
def table_browse(spark, d):
    return table(spark, d, "files").select("id", "project_id", "path").orderBy(F.col("id").desc()).limit(20)
