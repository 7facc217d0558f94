"""Queries over commits: history, ownership, modules, co-change, clusters of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.functions import messages
from strataloom.functions.text import STOPWORDS
from strataloom.operators import derive, graph, history
from strataloom.plans.graph_queries import EDGES

QUERIES, SQL = {}, {}
FOLDER = "src"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


U = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sha ORDER BY entity_id) AS _r FROM commits) WHERE _r = 1)"
WHO = "coalesce(nullif(lower(trim(coalesce(author_email, ''))), ''), 'name:' || lower(trim(coalesce(nullif(author_name, ''), 'unknown'))))"
T = "t AS (SELECT u.* EXCLUDE (deletions), f.path, f.additions, f.deletions FROM commit_files f JOIN u ON u.entity_id = f.commit_entity_id WHERE f.path <> '')"
AS_OF = "(SELECT max(authored_at) FROM commits)"
AGE = f"(date_sub('second', authored_at, {AS_OF}) / 86400.0)"
DECAY = f"exp(greatest({AGE}, 0) * (-0.6931471805599453 / 180.0))"
MODULE = "CASE WHEN instr({0}, '/') = 0 THEN '.' ELSE array_to_string(list_slice(string_split({0}, '/'), 1, least(len(string_split({0}, '/')) - 1, 2)), '/') END"


def as_of(spark: SparkSession, d: str):
    """The latest commit time as a literal: one tiny aggregate, so no plan depends on the clock."""
    at = table(spark, d, "commits").agg(F.max("authored_at").cast("string")).first()[0]
    return F.lit(at).cast("timestamp_ntz")


@query(f"""WITH {U}, {T}, h AS (SELECT DISTINCT entity_id FROM t WHERE path = '{FOLDER}' OR starts_with(path, '{FOLDER}/')), c AS (SELECT entity_id, path, sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS churn FROM t GROUP BY 1, 2),
p AS (SELECT entity_id, path, row_number() OVER (PARTITION BY entity_id ORDER BY churn DESC, path) AS r FROM c WHERE entity_id IN (SELECT entity_id FROM h)), l AS (SELECT entity_id, string_agg(path, ',' ORDER BY r) AS paths FROM p WHERE r <= 5 GROUP BY 1)
SELECT u.project_id, u.sha, u.subject, u.author_name AS author, u.authored_at, u.is_fix, l.paths FROM u JOIN l USING (entity_id)""")
def history_for_target(spark, d):
    return history.timeline(table(spark, d, "commits"), table(spark, d, "commit_files"), FOLDER)


@query(f"""WITH {U} SELECT project_id, count(*) AS commits, count(*) FILTER (WHERE is_fix) AS fixes, count(*) FILTER (WHERE is_revert) AS reverts, count(*) FILTER (WHERE is_merge) AS merges, count(DISTINCT {WHO}) AS contributors, min(authored_at) AS first_at, max(authored_at) AS last_at FROM u GROUP BY 1""")
def history_summary(spark, d):
    return history.summary(table(spark, d, "commits"))


@query(f"""WITH {U}, w AS (SELECT project_id, {WHO} AS person, round(sum({DECAY}), 4) AS weight, count(*) AS commits, count(*) FILTER (WHERE is_fix) AS fixes, max(authored_at) AS last_at, CAST(sum(coalesce(insertions, 0) + coalesce(deletions, 0)) AS BIGINT) AS churn FROM u WHERE NOT coalesce(is_merge, false) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, person) AS rank FROM w) SELECT *, round(weight / sum(weight) OVER (PARTITION BY project_id), 4) AS share FROM r WHERE rank <= 10""")
def owners_decayed(spark, d):
    return history.owners(table(spark, d, "commits"), as_of(spark, d))


@query(f"""WITH {U} SELECT project_id, {WHO} AS person, count(*) AS commits, min(authored_at) AS first_at, max(authored_at) AS last_at, coalesce(array_to_string(list_sort(list_distinct(list(author_email))), ','), '') AS emails FROM u GROUP BY 1, 2""")
def people_stats(spark, d):
    return history.people(table(spark, d, "commits"))


@query("""WITH below AS (SELECT DISTINCT project_id, path FROM commit_files WHERE starts_with(path, 'src/')) SELECT project_id, 'directory' AS how, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path) AS r FROM below) WHERE r <= 5000""")
def resolve_target_paths(spark, d):
    return history.resolve_target("src", table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "commit_files"))


@query(f"""SELECT f.project_id, {MODULE.format('f.path')} AS module, count(*) AS files, CAST(sum(coalesce(f.loc, 0)) AS BIGINT) AS loc, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS symbols FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) s ON s.file_id = f.id GROUP BY 1, 2""")
def module_rollup(spark, d):
    return derive.modules(table(spark, d, "files"), table(spark, d, "symbols"))


@query("WITH " + EDGES + f""", h AS (SELECT s.id, {MODULE.format('f.path')} AS m FROM symbols s JOIN files f ON f.id = s.file_id) SELECT r.project_id, a.m AS from_module, c.m AS to_module, count(*) AS edges FROM resolved r JOIN h a ON a.id = r.src JOIN h c ON c.id = r.dst WHERE a.m <> c.m GROUP BY 1, 2, 3""")
def module_deps(spark, d):
    symbols = table(spark, d, "symbols")
    return derive.module_dependencies(graph.resolve_edges(graph.call_edges(symbols), symbols), symbols, table(spark, d, "files"))


_METRICS = f"""{U}, {T}, k AS (SELECT DISTINCT project_id, {MODULE.format('path')} AS module FROM files),
m AS (SELECT t.project_id, {MODULE.format('t.path')} AS module, t.entity_id, t.is_fix, {WHO} AS person, coalesce(additions, 0) AS a, coalesce(deletions, 0) AS b FROM t WHERE NOT coalesce(is_merge, false) AND {AGE} BETWEEN 0 AND 90),
g AS (SELECT m.project_id, m.module, count(DISTINCT entity_id) AS commits, count(DISTINCT CASE WHEN is_fix THEN entity_id END) AS fix_commits, count(DISTINCT person) AS authors, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(b) AS BIGINT) AS deletions, CAST(sum(a + b) AS BIGINT) AS churn FROM m JOIN k ON k.project_id = m.project_id AND k.module = m.module GROUP BY 1, 2),
x AS (SELECT *, max(churn) OVER (PARTITION BY project_id) AS mx, max(fix_commits > 0) OVER (PARTITION BY project_id) AS fx, fix_commits / CAST(commits AS DOUBLE) AS density FROM g),
metrics AS (SELECT project_id, module, commits, fix_commits, authors, additions, deletions, churn, round(density, 6) AS density, round(CASE WHEN mx <= 0 THEN 0 WHEN fx THEN 100 * sqrt(churn / CAST(mx AS DOUBLE) * least(greatest(density, 0), 1)) ELSE 100.0 * churn / mx END, 6) AS risk FROM x)"""


def _metrics(spark, d) -> DataFrame:
    out = derive.module_metrics(table(spark, d, "commits"), table(spark, d, "commit_files"), table(spark, d, "files"), as_of(spark, d))
    return out.withColumn("density", F.round("density", 6)).withColumn("risk", F.round("risk", 6))


@query("WITH " + _METRICS + " SELECT * FROM metrics")
def module_metrics_risk(spark, d):
    return _metrics(spark, d)


@query("WITH " + _METRICS + " SELECT * FROM (SELECT project_id, module, risk, churn, row_number() OVER (PARTITION BY project_id ORDER BY risk DESC, module) AS rank FROM metrics) WHERE rank <= 30")
def get_modules(spark, d):
    from strataloom.functions.ranking import with_rank

    return with_rank(_metrics(spark, d).select("project_id", "module", "risk", "churn"), ["project_id"], F.col("risk").desc(), F.col("module"), keep=30)


@query(f"""WITH {U}, {T}, k AS (SELECT DISTINCT project_id, {MODULE.format('path')} AS module FROM files),
g AS (SELECT t.project_id, {MODULE.format('t.path')} AS module, {WHO} AS person, sum((coalesce(additions, 0) + coalesce(deletions, 0)) * {DECAY}) AS weight, count(DISTINCT entity_id) AS commits, max(authored_at) AS last_at FROM t WHERE NOT coalesce(is_merge, false) GROUP BY 1, 2, 3)
SELECT g.project_id, g.module, g.person, round(weight, 4) AS weight, commits, last_at, round(CASE WHEN sum(weight) OVER (PARTITION BY g.project_id, g.module) > 0 THEN weight / sum(weight) OVER (PARTITION BY g.project_id, g.module) ELSE 0 END, 4) AS share FROM g JOIN k ON k.project_id = g.project_id AND k.module = g.module""")
def module_ownership(spark, d):
    out = derive.module_owners(table(spark, d, "commits"), table(spark, d, "commit_files"), table(spark, d, "files"), as_of(spark, d))
    return out.withColumn("weight", F.round("weight", 4)).withColumn("share", F.round("share", 4))


_COCHANGE = f"""{U}, s AS (SELECT entity_id, project_id FROM u WHERE NOT coalesce(is_merge, false)), n AS (SELECT project_id, count(*) AS n FROM s GROUP BY 1),
tt AS (SELECT DISTINCT s.project_id, s.entity_id, f.path FROM commit_files f JOIN s ON s.entity_id = f.commit_entity_id WHERE f.path <> ''), c AS (SELECT project_id, path, count(*) AS c FROM tt GROUP BY 1, 2),
k AS (SELECT * FROM tt WHERE entity_id IN (SELECT entity_id FROM tt GROUP BY 1 HAVING count(*) <= 50)),
p AS (SELECT x.project_id, x.path AS path_a, y.path AS path_b, count(*) AS pair_commits FROM k x JOIN k y ON x.entity_id = y.entity_id AND x.path < y.path GROUP BY 1, 2, 3 HAVING count(*) >= 2),
pairs AS (SELECT p.*, a.c AS a_commits, b.c AS b_commits, round(pair_commits / CAST(least(a.c, b.c) AS DOUBLE), 6) AS confidence, round(pair_commits * n.n / CAST(a.c * b.c AS DOUBLE), 6) AS lift FROM p JOIN c a ON a.project_id = p.project_id AND a.path = p.path_a JOIN c b ON b.project_id = p.project_id AND b.path = p.path_b JOIN n ON n.project_id = p.project_id)"""


def _pairs(spark, d) -> DataFrame:
    out = derive.cochange(table(spark, d, "commits"), table(spark, d, "commit_files"))
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("lift", F.round("lift", 6))


@query("WITH " + _COCHANGE + " SELECT * FROM pairs")
def cochange_pairs(spark, d):
    return _pairs(spark, d)


_IN = "({0} = 'src' OR starts_with({0}, 'src/'))"


@query("WITH " + _COCHANGE + f""", o AS (SELECT project_id, CASE WHEN {_IN.format('path_a')} THEN path_a ELSE path_b END AS path, CASE WHEN {_IN.format('path_a')} THEN path_b ELSE path_a END AS other, pair_commits, confidence FROM pairs WHERE {_IN.format('path_a')} <> {_IN.format('path_b')})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, pair_commits DESC, other, path) AS rank FROM o) WHERE rank <= 15""")
def cochange_for_target(spark, d):
    return derive.cochange_of(_pairs(spark, d), FOLDER)


_DOMINANT = f"""dm AS (SELECT entity_id, module, touches FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY touches DESC, module) AS r FROM (SELECT entity_id, {MODULE.format('path')} AS module, count(*) AS touches FROM t GROUP BY 1, 2)) WHERE r = 1)"""


@query(f"WITH {U}, {T}, {_DOMINANT} SELECT * FROM dm")
def dominant_module(spark, d):
    return derive.dominant_module(table(spark, d, "commits"), table(spark, d, "commit_files"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN (" + _STOP + ")))"


@query(f"WITH e AS (SELECT source, doc_id, unnest({TERMS.format('text')}) AS term FROM documents) SELECT source, term, count(*) AS df FROM e GROUP BY 1, 2")
def term_doc_freq(spark, d):
    return derive.term_frequencies(table(spark, d, "documents"), "source", "doc_id", "text")[1]


@query(f"""WITH e AS (SELECT source, doc_id, unnest({TERMS.format('text')}) AS term FROM documents), f AS (SELECT source, term, count(*) AS df FROM e GROUP BY 1, 2)
SELECT source, doc_id, term, df FROM (SELECT e.source, e.doc_id, e.term, f.df, row_number() OVER (PARTITION BY e.source, e.doc_id ORDER BY f.df DESC, e.term) AS r FROM e JOIN f ON f.source = e.source AND f.term = e.term) WHERE r = 1""")
def bucket_term(spark, d):
    return derive.bucket_terms(table(spark, d, "documents"), "source", "doc_id", "text")


@query(f"""WITH e AS (SELECT project_id, doc_type, doc_id, unnest({TERMS.format('text')}) AS term FROM documents), z AS (SELECT project_id, doc_type, count(*) AS size FROM documents GROUP BY 1, 2), w AS (SELECT project_id, count(*) AS n FROM documents GROUP BY 1),
i AS (SELECT project_id, doc_type, term, count(*) AS c FROM e GROUP BY 1, 2, 3), a AS (SELECT project_id, term, count(*) AS t FROM e GROUP BY 1, 2),
s AS (SELECT i.project_id, i.doc_type, i.term, round((c / CAST(size AS DOUBLE)) * ln((c / CAST(size AS DOUBLE) + 1.0 / (n + 1)) / (CASE WHEN n > size THEN (t - c) / CAST(n - size AS DOUBLE) ELSE 0 END + 1.0 / (n + 1))), 6) AS score FROM i JOIN z ON z.project_id = i.project_id AND z.doc_type = i.doc_type JOIN a ON a.project_id = i.project_id AND a.term = i.term JOIN w ON w.project_id = i.project_id)
SELECT * FROM (SELECT project_id, doc_type, row_number() OVER (PARTITION BY project_id, doc_type ORDER BY score DESC, term) AS rank, term, score FROM s WHERE score > 0) WHERE rank <= 3""")
def top_terms(spark, d):
    return derive.top_terms(table(spark, d, "documents"), "project_id", "doc_type", "doc_id", "text")


@query(f"""WITH {U}, {T}, {_DOMINANT}, fx AS (SELECT project_id, entity_id, authored_at, subject FROM u WHERE is_fix), e AS (SELECT project_id, entity_id, unnest({TERMS.format('subject')}) AS term FROM fx), q AS (SELECT project_id, term, count(*) AS df FROM e GROUP BY 1, 2),
bt AS (SELECT entity_id, term FROM (SELECT e.entity_id, e.term, row_number() OVER (PARTITION BY e.project_id, e.entity_id ORDER BY q.df DESC, e.term) AS r FROM e JOIN q ON q.project_id = e.project_id AND q.term = e.term) WHERE r = 1)
SELECT fx.project_id, coalesce(dm.module, '') AS module, bt.term, count(*) AS size, min(authored_at) AS first_at, max(authored_at) AS last_at FROM fx JOIN bt USING (entity_id) LEFT JOIN dm USING (entity_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def bug_clusters_terms(spark, d):
    return derive.fix_clusters(table(spark, d, "commits"), table(spark, d, "commit_files"))


@query(f"""WITH {U}, {T}, {_DOMINANT}, fx AS (SELECT project_id, entity_id, sha, authored_at, subject FROM u WHERE is_fix), e AS (SELECT project_id, entity_id, unnest({TERMS.format('subject')}) AS term FROM fx), q AS (SELECT project_id, term, count(*) AS df FROM e GROUP BY 1, 2),
bt AS (SELECT entity_id, term FROM (SELECT e.entity_id, e.term, row_number() OVER (PARTITION BY e.project_id, e.entity_id ORDER BY q.df DESC, e.term) AS r FROM e JOIN q ON q.project_id = e.project_id AND q.term = e.term) WHERE r = 1),
x AS (SELECT fx.project_id, coalesce(dm.module, '') AS module, bt.term, fx.sha, fx.subject, fx.authored_at FROM fx JOIN bt USING (entity_id) LEFT JOIN dm USING (entity_id)), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, module, term ORDER BY authored_at DESC NULLS LAST, sha) AS n, count(*) OVER (PARTITION BY project_id, module, term) AS size FROM x)
SELECT project_id, module, term, n, sha, subject FROM n WHERE size >= 2 AND n <= 5""")
def bug_cluster_examples(spark, d):
    """The five newest fixes of every cluster."""
    return derive.cluster_examples(table(spark, d, "commits"), table(spark, d, "commit_files"))


@query(f"""WITH {U}, {T}, x AS (SELECT entity_id, any_value(project_id) AS project_id, any_value(authored_at) AS authored_at, any_value({WHO}) AS person, sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS churn FROM t WHERE NOT coalesce(is_merge, false) AND (path = '{FOLDER}' OR starts_with(path, '{FOLDER}/')) GROUP BY 1),
w AS (SELECT project_id, person, round(sum({DECAY}), 4) AS weight, count(*) AS commits, CAST(sum(churn) AS BIGINT) AS churn FROM x GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, person) AS rank FROM w) WHERE rank <= 10""")
def owners_of_folder(spark, d):
    """Who owns a folder, by commits that touch it and the churn inside it."""
    return history.owners_within(table(spark, d, "commits"), table(spark, d, "commit_files"), as_of(spark, d), FOLDER)


@query(f"""WITH {U} SELECT project_id, person, sha, subject FROM (SELECT *, {WHO} AS person, row_number() OVER (PARTITION BY project_id, {WHO} ORDER BY authored_at DESC NULLS LAST, sha) AS n FROM u) WHERE n = 1""")
def latest_per_person(spark, d):
    return history.latest_of_people(table(spark, d, "commits"))


@query()
def bug_clusters_semantic(spark, d):
    """Leader clusters over the labelled vectors; a fold, so there is no SQL for it."""
    return derive.leader_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(r"""SELECT entity_id, (regexp_matches(coalesce(subject, ''), '(?i)(^|[-–—:|/\\\]\s])\s*(fix|fixes|fixed|bugfix|hotfix)(\([^)]*\))?\s*:') OR regexp_matches(regexp_replace(coalesce(subject, ''), '^\s*(\[[^\]]*\]|\([^)]*\)|[A-Z][A-Z0-9]{1,9}-\d{1,7}|[^:]{1,40}\s[-–—]\s)\s*', ''), '(?i)^\s*(fix|fixes|fixed|fixing|bugfix|hotfix|regression)\b')) AS fix,
 (regexp_matches(coalesce(subject, ''), '(?i)\brevert(s|ed|ing)?\b') OR regexp_matches(coalesce(body, ''), '(?im)^This reverts commit\b')) AS revert FROM commits""")
def classify_fix_revert(spark, d):
    c = table(spark, d, "commits")
    return c.select("entity_id", messages.is_fix(F.col("subject")).alias("fix"), messages.is_revert(F.col("subject"), F.col("body")).alias("revert"))


@query(r"""WITH m AS (SELECT entity_id, concat_ws(chr(10), subject, body) AS text FROM commits), h AS (SELECT entity_id, unnest(regexp_extract_all(text, '(?:^|[^\w#/&])#(\d{1,7})', 1)) AS issue, false AS closes FROM m),
c AS (SELECT entity_id, unnest(regexp_extract_all(text, '(?i)\b(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\s*:?\s+#(\d{1,7})\b', 1)) AS issue, true AS closes FROM m)
SELECT entity_id, 'github' AS tracker, issue, CASE WHEN bool_or(closes) THEN 'FIXES' ELSE 'REFERENCES' END AS relation, CAST(NULL AS VARCHAR) AS url FROM (SELECT * FROM h UNION ALL SELECT * FROM c) GROUP BY 1, 3""")
def issue_refs(spark, d):
    c = table(spark, d, "commits").withColumn("message", F.concat_ws("\n", "subject", "body"))
    return messages.issue_refs(c, "entity_id", "message")


@query("SELECT event_type AS provider, user_id % 5 AS model, count(*) AS calls, round(sum(value), 4) AS tokens, round(sum(value) / 1e6 * 0.12, 4) AS cost FROM events GROUP BY 1, 2")
def usage_cost(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("model"))
    return rows.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.sum("value") / 1e6 * 0.12, 4).alias("cost"))


@query("""WITH k AS (SELECT project_id, unnest(['modules', 'cochange']) AS kind, count(*) || ':' || max(sha) AS watermark FROM commits GROUP BY 1), s AS (SELECT project_id, kind, watermark AS old FROM k WHERE kind = 'modules' AND project_id % 2 = 0)
SELECT k.project_id, k.kind, k.watermark, s.old IS DISTINCT FROM k.watermark AS todo FROM k LEFT JOIN s USING (project_id, kind)""")
def derived_watermark_skip(spark, d):
    marks = table(spark, d, "commits").groupBy("project_id").agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.max("sha")).alias("watermark"))
    kinds = marks.select("project_id", F.explode(F.array(F.lit("modules"), F.lit("cochange"))).alias("kind"), "watermark")
    state = kinds.filter("kind = 'modules' AND project_id % 2 = 0")
    return derive.skip_unchanged(kinds, state)


@query(f"""WITH {U}, {T}, c AS (SELECT project_id, entity_id, sha, any_value(subject) AS subject, list_sort(list_distinct(list(path))) AS paths, any_value(authored_at) AS authored_at FROM t WHERE NOT coalesce(is_merge, false) AND NOT coalesce(is_revert, false) GROUP BY 1, 2, 3),
e AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY authored_at, sha) AS ord, count(*) OVER (PARTITION BY project_id) AS n FROM c WHERE len(paths) BETWEEN 1 AND 6 AND length(subject) >= 15 AND len(string_split(trim(subject), ' ')) >= 3)
SELECT project_id, sha, CAST(ord AS BIGINT) AS ord, len(paths) AS n_paths FROM e WHERE (ord - 1) % greatest(CAST(floor(n / 25.0) AS BIGINT), 1) = 0""")
def eval_sample_stride(spark, d):
    from strataloom.plans.evaluation import sample_commits

    return sample_commits(table(spark, d, "commits"), table(spark, d, "commit_files"))
