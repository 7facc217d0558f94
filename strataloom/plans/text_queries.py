"""Queries over documents, chunks and searches."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.functions import documents as docs
from strataloom.functions.ranking import item_cost, pack, reciprocal_ranks, with_rank
from strataloom.functions.text import common_scope, content_key, search_subject, slug, statement_norm, token_estimate, tokens
from strataloom.operators import search
from strataloom.plans import evaluation

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda w: w <> '')"
_OK = "CASE WHEN len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0 THEN CAST({0} AS DOUBLE[]) END"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _index(name: str, rows: str, key: str, fields: dict[str, float]) -> str:
    """An inverted index over the fields, as common table expressions."""
    parts = " UNION ALL ".join(f"SELECT project_id, {key} AS k, token, {w} * count(*) / (1.0 + count(*)) AS w FROM (SELECT project_id, {key}, unnest({_TOK.format(c)}) AS token FROM {rows}) GROUP BY 1, 2, 3" for c, w in fields.items())
    return f"{name} AS (SELECT project_id, k, token, max(w) AS w FROM ({parts}) GROUP BY 1, 2, 3)"


def _lexical(name: str, index: str, pool: int) -> str:
    return f"""{name} AS (SELECT query_id, k, rank FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM (SELECT i.k, w.query_id, round(sum(i.w), 6) AS score, count(*) AS n, any_value(w.need) AS need FROM {index} i JOIN words w ON w.project_id = i.project_id AND w.token = i.token GROUP BY 1, 2) WHERE n = need) WHERE rank <= {pool})"""


def _nearest(name: str, rows: str, key: str, pool: int) -> str:
    return f"""{name}_v AS (SELECT project_id, {key} AS k, {_OK.format('embedding')} AS v FROM {rows}), {name} AS (SELECT query_id, k, rank FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM (SELECT q.query_id, r.k, round({_DOT.format('r.v', 'q.v')} / (sqrt({_DOT.format('r.v', 'r.v')}) * sqrt({_DOT.format('q.v', 'q.v')})), 6) AS score FROM {name}_v r JOIN qv q ON q.project_id = r.project_id WHERE r.v IS NOT NULL AND q.v IS NOT NULL)) WHERE rank <= {pool})"""


_Q = f"""qv AS (SELECT query_id, project_id, {_OK.format('embedding')} AS v FROM search_queries),
words AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS need FROM (SELECT query_id, project_id, unnest(list_distinct({_TOK.format('query_text')})) AS token FROM search_queries))"""
_SYMBOL_INDEX = _index("si", "symbols", "id", {"name": 1.0, "doc": 0.4, "body": 0.2})


def _fused(lists: dict[str, str], limit: int, key: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, k, '{s}' AS source, rank FROM {t}" for s, t in lists.items())
    return f"""SELECT query_id, k AS {key}, score, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM (SELECT query_id, k, round(sum(1.0 / (60 + rank)), 6) AS score, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ({union}) GROUP BY 1, 2)) WHERE rank <= {limit}"""


@query(f"WITH {_Q}, {_SYMBOL_INDEX}, {_lexical('lx', 'si', 50)}, {_nearest('nv', 'symbols', 'id', 50)} " + _fused({"fts": "lx", "vector": "nv"}, 10, "symbol_id"))
def hybrid_search_rrf(spark, d):
    out = search.search_code(table(spark, d, "symbols"), table(spark, d, "search_queries"), 10)
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_Q}, {_SYMBOL_INDEX}, {_lexical('lx', 'si', 50)} SELECT query_id, k AS symbol_id, rank FROM lx")
def fts_and_topk(spark, d):
    rows = table(spark, d, "symbols").withColumn("symbol_id", F.col("id"))
    return search.lexical_search(rows, table(spark, d, "search_queries"), "symbol_id", search.FIELD_WEIGHTS, ["project_id"], 50).select("query_id", "symbol_id", "rank")


@query(f"WITH {_Q}, {_nearest('nv', 'symbols', 'id', 10)} SELECT query_id, k AS symbol_id, rank FROM nv")
def vector_topk_cosine(spark, d):
    rows = table(spark, d, "symbols").withColumn("symbol_id", F.col("id"))
    return search.nearest(rows, table(spark, d, "search_queries"), "symbol_id", ["project_id"], 10).select("query_id", "symbol_id", "rank")


@query(f"""WITH {_Q}, sy AS (SELECT *, 'sym:' || id AS item FROM symbols), ch AS (SELECT *, 'chunk:' || id AS item FROM chunks), {_index('si', 'sy', 'item', {"name": 1.0, "doc": 0.4, "body": 0.2})}, {_index('ci', 'ch', 'item', {"heading_path": 1.0, "content": 0.4})},
{_lexical('l1', 'si', 50)}, {_nearest('n1', 'sy', 'item', 50)}, {_lexical('l2', 'ci', 50)}, {_nearest('n2', 'ch', 'item', 50)} """ + _fused({"code_fts": "l1", "code_vector": "n1", "doc_fts": "l2", "doc_vector": "n2"}, 10, "item"))
def knowledge_search_4way(spark, d):
    out = search.search_knowledge(table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "search_queries"), 10)
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH s AS (SELECT min(id) AS seed, project_id FROM symbols WHERE {_OK.format('embedding')} IS NOT NULL GROUP BY 2), v AS (SELECT id, project_id, {_OK.format('embedding')} AS v FROM symbols),
p AS (SELECT s.seed, b.id, round({_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')})), 6) AS score FROM s JOIN v a ON a.id = s.seed JOIN v b ON b.project_id = s.project_id AND b.id <> s.seed WHERE b.v IS NOT NULL)
SELECT seed, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 5""")
def find_related(spark, d):
    from strataloom.functions.vectors import usable

    s = table(spark, d, "symbols")
    seeds = s.filter(usable(F.col("embedding")).isNotNull()).groupBy("project_id").agg(F.min_by(F.struct("id", "embedding"), "id").alias("x")).select("x.id", "project_id", "x.embedding")
    return search.related(s, seeds, "id", "project_id", 5)


@query("""WITH m AS (SELECT doc_id AS memory_id, doc_id % 50 = 0 AS pinned, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 END AS supersedes, length(text) AS score FROM documents WHERE text IS NOT NULL),
a AS (SELECT * FROM m ANTI JOIN (SELECT supersedes AS memory_id FROM m WHERE supersedes IS NOT NULL) s USING (memory_id))
SELECT memory_id, pinned, CASE WHEN NOT pinned THEN CAST(score AS DOUBLE) END AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY pinned DESC, CASE WHEN NOT pinned THEN score END DESC NULLS LAST, memory_id) AS rank FROM a) WHERE rank <= 30""")
def recall_pinned_first(spark, d):
    m = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 50 == 0).alias("pinned"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).alias("supersedes"), F.length("text").cast("double").alias("score"))
    return search.recall(m.select("memory_id", "pinned", "supersedes"), m.select("memory_id", "score"), 30)


def _channels(spark, d):
    """Items of three channels, as a composed context has them: documents by length, symbols by lines, commits by churn."""
    docs_ = table(spark, d, "documents").filter("text IS NOT NULL").select("project_id", F.lit("doc").alias("channel"), F.concat(F.lit("k:"), (F.col("doc_id") % 400).cast("string")).alias("key"), F.length("text").cast("double").alias("s"), "title", F.col("doc_id").alias("id"))
    code = table(spark, d, "symbols").select("project_id", F.lit("code").alias("channel"), F.concat(F.lit("k:"), (F.col("id") % 400).cast("string")).alias("key"), (F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))).cast("double").alias("s"), F.col("name").alias("title"), "id")
    hist = table(spark, d, "commits").select("project_id", F.lit("history").alias("channel"), F.concat(F.lit("k:"), (F.col("entity_id") % 400).cast("string")).alias("key"), F.coalesce("insertions", F.lit(0)).cast("double").alias("s"), F.col("subject").alias("title"), F.col("entity_id").alias("id"))
    rows = docs_.unionByName(code).unionByName(hist)
    return with_rank(rows, ["project_id", "channel"], F.col("s").desc(), F.col("id"), keep=100)


_CHANNELS = """r AS (SELECT project_id, 'doc' AS channel, 'k:' || (doc_id % 400) AS key, CAST(length(text) AS DOUBLE) AS s, title, doc_id AS id FROM documents WHERE text IS NOT NULL
UNION ALL SELECT project_id, 'code', 'k:' || (id % 400), CAST(coalesce(end_line, 0) - coalesce(start_line, 0) AS DOUBLE), name, id FROM symbols UNION ALL SELECT project_id, 'history', 'k:' || (entity_id % 400), CAST(coalesce(insertions, 0) AS DOUBLE), subject, entity_id FROM commits),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, channel ORDER BY s DESC, id) AS rank FROM r) WHERE rank <= 100),
f AS (SELECT project_id, key, round(sum(CASE channel WHEN 'code' THEN 1.0 WHEN 'doc' THEN 0.8 ELSE 0.6 END / (60 + rank)), 6) AS score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM c GROUP BY 1, 2)"""


@query(f"WITH {_CHANNELS} SELECT * FROM f")
def weighted_fusion(spark, d):
    from strataloom.functions.ranking import CHANNEL_WEIGHTS

    out = reciprocal_ranks(_channels(spark, d), ["project_id"], "key", "channel", "rank", CHANNEL_WEIGHTS)
    return out.select("project_id", "key", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("channels"))


@query("""WITH RECURSIVE i AS (SELECT project_id, CAST(doc_id AS VARCHAR) AS key, CAST(ceil(length(coalesce(title, '')) / 4.0) + ceil(length(coalesce(left(text, 600), '')) / 4.0) + ceil(length(coalesce(source, '')) / 4.0) + 4 AS BIGINT) AS cost, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS rank, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(n_chars, 0) DESC, doc_id) <= 2 AS pinned FROM documents WHERE project_id IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT pinned, rank, key) AS n FROM i WHERE rank <= 200),
p AS (SELECT project_id, key, n, true AS taken, cost AS used FROM l WHERE n = 1 UNION ALL SELECT l.project_id, l.key, l.n, l.pinned OR p.used + l.cost <= 6000, CASE WHEN l.pinned OR p.used + l.cost <= 6000 THEN p.used + l.cost ELSE p.used END FROM p JOIN l ON l.project_id = p.project_id AND l.n = p.n + 1)
SELECT project_id, key, taken, used AS tokens_after FROM p""")
def budget_pack(spark, d):
    rows = table(spark, d, "documents").filter("project_id IS NOT NULL").select("project_id", F.col("doc_id").cast("string").alias("key"), item_cost(F.col("title"), F.substring("text", 1, 600), F.col("source")).alias("cost"), F.coalesce("n_chars", F.lit(0)).alias("n"), "doc_id")
    top = with_rank(rows, ["project_id"], F.col("n").desc(), F.col("doc_id"), keep=200).withColumn("pinned", F.col("rank") <= 2)
    return pack(top, ["project_id"], 6000)


@query()
def markdown_chunks(spark, d):
    """Chunks of every document; a fold over lines, tested by truth tables."""
    return docs.chunk_rows(table(spark, d, "documents"))


def _cue_sql() -> str:
    """The strongest cue of ``said`` as a struct, as the operator's definition has it."""
    rows = []
    for k, (words, confidence) in enumerate(docs.CUES):
        found = docs.cue_pattern(words).replace("'", "''")
        before, cue = (f"regexp_extract(said, '{found}', {g})" for g in (1, 2))
        place = f"regexp_matches({before}, '(^|[—–:;(]|--)[ \t]*$')" if k == 0 else f"NOT regexp_matches({before}, '(?i)(?:^|{docs._EDGE})(?:{docs.STATES}){docs._EDGE}*$')"
        rows.append(f"WHEN {cue} <> '' AND {place} THEN struct_pack(confidence := CAST({confidence} AS DOUBLE), cue := lower({cue}))")
    return "CASE " + " ".join(rows) + " END"


_NORMATIVE = rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?ms)^[ \t]*(?:```.*?(?:^[ \t]*```[^\n]*$|\z)|~~~.*?(?:^[ \t]*~~~[^\n]*$|\z))', '', 'g'), '[ \t\r\f]*\n[ \t\r\f]*', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t\r\f]*[#>|][^\n]*$', '', 'g'), '(?m)^[ \t\r\f]*(?:[-*+]|[0-9]+[.)])[ \t]+', chr(10), 'g') AS t FROM a),
 p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\n+')) AS p FROM b),
 s AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(p, chr(10), ' '), '([.!?])[ \t\r\f]+', '\1' || chr(1), 'g'), chr(1))) AS r FROM p),
 w AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(r, '\*\*|__|`', '', 'g'), '^[ \t\r\f*_-]+', ''), '[ \t\r\f*_]+$', '') AS said FROM s),
 v AS (SELECT doc_id, said FROM w WHERE length(said) BETWEEN 1 AND {docs.LONGEST} AND NOT suffix(said, '?') AND regexp_matches(said, '^[^ \t]+(?:[ \t]+[^ \t]+){{{docs.FEWEST_WORDS - 1},}}') AND NOT regexp_matches(regexp_replace(said, '[.!]+$', ''), '(?i)(?:^|{docs._EDGE})(?:{docs.OPEN_END})$'))
 SELECT doc_id, regexp_replace(said, '[.;,]+$', '') AS sentence, c.confidence AS confidence, c.cue AS cue FROM (SELECT *, {_cue_sql()} AS c FROM v) WHERE c IS NOT NULL"""


@query(_NORMATIVE)
def normative_sentences(spark, d):
    """Sentences that prescribe, of every document."""
    return docs.rule_sentences(table(spark, d, "documents"))


@query("WITH n AS (" + _NORMATIVE + r"""), s AS (SELECT doc_id, sentence, greatest(0.1, least(0.95, round(confidence, 2))) AS confidence, regexp_replace(regexp_replace(lower(trim(sentence)), '\s+', ' ', 'g'), '[.!?;:,]+$', '') AS norm FROM n)
SELECT rule_key, statement, confidence, 'doc' AS origin, origin_ref FROM (SELECT 'rule:' || substr(sha256(norm || '|'), 1, 12) AS rule_key, sentence AS statement, confidence, doc_id AS origin_ref, row_number() OVER (PARTITION BY norm ORDER BY confidence DESC, doc_id, sentence) AS r FROM s WHERE confidence >= 0.4) WHERE r = 1""")
def rule_candidates(spark, d):
    from strataloom.operators.knowledge import propose

    return propose(table(spark, d, "documents"), "doc")


_FENCE = r"(?ms)^[ \t]*(?:```.*?(?:^[ \t]*```[^\n]*$|\z)|~~~.*?(?:^[ \t]*~~~[^\n]*$|\z))"
#: Lines of every text, a fence being one line (its line ends hidden), and sections numbered by the headings before them.
_SECTIONS = rf"""f AS (SELECT doc_id, string_split(regexp_replace(text, '{_FENCE}', '⟦⟧', 'g'), '⟦⟧') AS p, list_transform(regexp_extract_all(text, '{_FENCE}'), lambda x: replace(x, chr(10), '⟦n⟧')) AS c FROM prose WHERE text IS NOT NULL),
w AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(c[i], '')), '') AS text FROM f),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM w),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+\S') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM h),
sec AS (SELECT doc_id, s, max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END) AS level, max(CASE WHEN head THEN regexp_extract(line, '^#+\s+(\S.*?)\s*#*\s*$', 1) ELSE '' END) AS heading, replace(array_to_string(list(CASE WHEN head THEN NULL ELSE line END ORDER BY n), chr(10)), '⟦n⟧', chr(10)) AS body FROM g GROUP BY 1, 2),
kept AS (SELECT *, regexp_replace(regexp_replace(body, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ''), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '') AS inner_text FROM sec WHERE s > 0 OR regexp_matches(body, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]'))"""


@query(f"""WITH prose AS (SELECT doc_id, text FROM documents), {_SECTIONS}, up AS (SELECT a.doc_id, b.s, string_agg(a.heading, ' > ' ORDER BY a.s) AS trail FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.s <= b.s AND a.level > 0 AND (a.s = b.s OR (a.level < b.level AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.doc_id = a.doc_id AND x.s > a.s AND x.s <= b.s AND x.level <= a.level))) GROUP BY 1, 2)
SELECT kept.doc_id, CAST(row_number() OVER (PARTITION BY kept.doc_id ORDER BY kept.s) - 1 AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, heading, coalesce(trail, '') AS heading_path, length(regexp_replace(inner_text, '\\s', '', 'g')) AS letters FROM kept LEFT JOIN up ON up.doc_id = kept.doc_id AND up.s = kept.s""")
def markdown_sections(spark, d):
    """The sections of every document with their breadcrumb; of the content the number of characters that are no blanks."""
    rows = docs.section_rows(table(spark, d, "documents"))
    heading = F.when(F.col("level") > 0, F.regexp_replace("content", r"^[^\n]*", "")).otherwise(F.col("content"))
    return rows.select("doc_id", "ord", "level", "heading", "heading_path", F.length(F.regexp_replace(heading, r"[ \t\n\r\f]", "")).alias("letters"))


#: Paths and identifiers of the prose; blanks and quotes are doubled, so that one can end a path and the other begin the next.
MENTIONS = rf"""p AS (SELECT doc_id, project_id, regexp_replace(text, '{_FENCE}', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
said AS (SELECT DISTINCT doc_id, project_id, 'identifier' AS kind, trim(unnest(regexp_extract_all(text, '`([^`\n]+)`', 1))) AS mention FROM p
 UNION ALL SELECT DISTINCT doc_id, project_id, 'path', unnest(regexp_extract_all(' ' || regexp_replace(text, '([\s`"''])', '\1\1', 'g') || ' ', '[\s`("''\[]((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{{1,5}})[\s`)"''\],.:;]', 1)) FROM p),
mentions AS (SELECT * FROM said WHERE CASE kind WHEN 'path' THEN lower(regexp_extract(mention, '([^.]*)$', 1)) IN ({", ".join(f"'{x}'" for x in docs.PATH_EXTENSIONS)}) ELSE regexp_full_match(mention, '[A-Za-z_$][A-Za-z0-9_$]*(?:::[A-Za-z_$][A-Za-z0-9_$]*)?') END)"""


@query(f"WITH {MENTIONS} SELECT doc_id, kind, mention FROM mentions")
def doc_mentions(spark, d):
    return docs.mention_rows(table(spark, d, "documents"))


_FRONT = r"""WITH h AS (SELECT doc_id, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1) AS head FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS n FROM h WHERE head <> ''),
k AS (SELECT *, regexp_matches(line, '^[A-Za-z0-9_.-]+\s*:') AS starts FROM l), g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM k),
v AS (SELECT doc_id, e, max(CASE WHEN starts THEN regexp_extract(line, '^([A-Za-z0-9_.-]+)', 1) END) AS field, max(CASE WHEN starts THEN trim(regexp_extract(line, '^[^:]*:(.*)$', 1), ' ' || chr(9) || chr(13)) END) AS value, list(regexp_extract(line, '^\s*-\s+(.*?)\s*$', 1) ORDER BY n) FILTER (NOT starts AND regexp_matches(line, '^\s*-\s+')) AS items FROM g WHERE e > 0 GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY e DESC) AS r FROM v)
SELECT doc_id, field, list_transform(CASE WHEN value = '' THEN coalesce(items, []) WHEN starts_with(value, '[') AND suffix(value, ']') THEN list_filter(list_transform(string_split(value[2:-2], ','), lambda x: trim(x)), lambda x: x <> '') ELSE [value] END, lambda x: regexp_replace(regexp_replace(trim(x), '^[''"]', ''), '[''"]$', '')) AS "values" FROM z WHERE r = 1"""


@query(_FRONT)
def front_matter(spark, d):
    return docs.front_matter_rows(table(spark, d, "documents"))


@query(rf"""WITH prose AS (SELECT doc_id, regexp_replace(text, '(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)', '') AS text FROM documents), {_SECTIONS}, fm AS ({_FRONT}),
m AS (SELECT doc_id, CASE WHEN regexp_matches(heading, '(?i)^status\b') THEN 'status' WHEN regexp_matches(heading, '(?i)^context\b') THEN 'context' WHEN regexp_matches(heading, '(?i)^decision\b') THEN 'decision' WHEN regexp_matches(heading, '(?i)^(consequences|outcome|results?)\b') THEN 'consequences' END AS part, s, nullif(inner_text, '') AS said FROM kept WHERE level > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY s) AS r FROM m WHERE part IS NOT NULL),
x AS (SELECT doc_id, max(CASE WHEN part = 'status' THEN nullif(string_split(said, chr(10))[1], '') END) AS status, max(CASE WHEN part = 'context' THEN said END) AS context, max(CASE WHEN part = 'decision' THEN said END) AS decision, max(CASE WHEN part = 'consequences' THEN said END) AS consequences FROM o WHERE r = 1 GROUP BY 1),
st AS (SELECT doc_id, nullif("values"[1], '') AS given FROM fm WHERE field = 'status')
SELECT d.doc_id, coalesce(given, status) AS status, context, decision, consequences FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN st ON st.doc_id = d.doc_id WHERE coalesce(given, status, context, decision, consequences) IS NOT NULL""")
def adr_sections(spark, d):
    """Parts of decision records; a status in the front matter comes before one in a section."""
    return docs.record_rows(table(spark, d, "documents"))


@query(r"""SELECT id AS file_id, CASE WHEN regexp_matches(lower(path), '(^|/)(adr|adrs|decisions|decision-records)/') OR regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^[0-9]{3,4}[-_]') THEN 'adr' WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^readme\b') THEN 'readme'
 WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^changelog\b') THEN 'changelog' WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^contributing\b') THEN 'contributing' WHEN regexp_matches(lower(path), '(^|/)(docs?|documentation|guides?)/') THEN 'guide' ELSE 'note' END AS doc_type FROM files""")
def doc_classify(spark, d):
    return table(spark, d, "files").select(F.col("id").alias("file_id"), docs.doc_type(F.col("path")).alias("doc_type"))


@query("""SELECT c.id, c.content_hash IS NOT DISTINCT FROM sha256(coalesce(heading_path, '') || chr(10) || coalesce(content, '')) AS fresh, c.content_hash IS NOT DISTINCT FROM sha256(coalesce(heading_path, '') || chr(10) || coalesce(content, '')) AND embedding IS NOT NULL AS keeps_embedding, CAST(ceil(length(coalesce(content, '')) / 4.0) AS INTEGER) AS tokens FROM chunks c""")
def chunk_embedding_invalidate(spark, d):
    """Re-chunked pieces against the stored ones: a vector stays only where the hash of breadcrumb and content is the stored one."""
    from strataloom.operators.store import refresh_chunks

    old = table(spark, d, "chunks").select("id", "content_hash", "embedding", "heading_path", "content")
    now = F.sha2(F.concat(F.coalesce("heading_path", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))), 256)
    new = old.withColumn("content_hash", now)
    joined = refresh_chunks(old.select("id", "content_hash", "embedding"), new, ["id"]).join(old.select("id", F.col("content_hash").alias("was")), "id")
    return joined.select("id", F.col("content_hash").eqNullSafe(F.col("was")).alias("fresh"), F.col("embedding").isNotNull().alias("keeps_embedding"), token_estimate(F.col("content")).alias("tokens"))


@query(r"""SELECT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(subject, ''), '(?i)^\s*(?:\w+\s*(?:\([^)]*\))?!?:)\s*', ''), '\(?#\d+\)?', ' ', 'g'), '\s+', ' ', 'g')) AS query, trim(regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 'rule:' || left(sha256(regexp_replace(regexp_replace(lower(trim(coalesce(subject, ''))), '\s+', ' ', 'g'), '[.!?;:,]+$', '') || '|'), 12) AS rule_key FROM commits""")
def text_keys(spark, d):
    c = table(spark, d, "commits")
    subject = F.coalesce("subject", F.lit(""))
    return c.select("entity_id", search_subject(F.col("subject")).alias("query"), slug(F.col("subject")).alias("slug"), content_key("rule", statement_norm(subject), F.lit("")).alias("rule_key"))


@query(f"""WITH q AS (SELECT item_id, list_distinct(list_filter({_TOK.format('text')}, lambda w: length(w) > 3)) AS ws FROM eval_items), w AS (SELECT item_id, unnest(ws) AS token, len(ws) AS need FROM q), t AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS token FROM documents WHERE text IS NOT NULL),
h AS (SELECT w.item_id, t.doc_id, count(*) AS n, any_value(w.need) AS need FROM w JOIN t USING (token) GROUP BY 1, 2), r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM h), rel AS (SELECT item_id, doc_id FROM h WHERE n = need),
x AS (SELECT rel.item_id, count(*) AS n, count(r.rank) AS found, min(r.rank) AS first FROM rel LEFT JOIN r ON r.item_id = rel.item_id AND r.doc_id = rel.doc_id AND r.rank <= 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg(found / CAST(n AS DOUBLE)), 6) AS recall, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM x""")
def eval_recall_mrr(spark, d):
    """Documents that hold every longer word of an item are its answers; ranking by words held is scored against them."""
    items = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.length(w) > 3))).alias("token"))
    need = items.groupBy("item_id").agg(F.count("*").alias("need"))
    words = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    hits = words.join(items, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    ranked = with_rank(hits, ["item_id"], F.col("n").desc(), F.col("doc_id"))
    return evaluation.scores(hits.join(need, "item_id").filter("n = need"), ranked, "item_id", "doc_id", 10)


@query("""WITH p AS (SELECT commit_entity_id AS entity_id, list_distinct(list(path)) AS ps FROM commit_files WHERE path <> '' GROUP BY 1),
s AS (SELECT entity_id, list_distinct(list_transform(ps, lambda x: array_to_string(list_slice(string_split(x, '/'), 1, len(string_split(x, '/')) - 1), '/'))) AS dirs, ps FROM p),
m AS (SELECT entity_id, ps, list_max(list_filter(list_transform(range(1, 12), lambda n: CASE WHEN len(list_distinct(list_transform(ps, lambda x: array_to_string(list_slice(string_split(x, '/'), 1, least(n, len(string_split(x, '/')) - 1)), '/') || CASE WHEN len(string_split(x, '/')) - 1 < n THEN '!' || x ELSE '' END))) = 1 THEN n END), lambda n: n IS NOT NULL)) AS depth FROM s)
SELECT entity_id, CASE WHEN len(ps) = 1 THEN ps[1] WHEN depth IS NOT NULL THEN array_to_string(list_slice(string_split(ps[1], '/'), 1, depth), '/') || '/**' END AS scope FROM m""")
def infer_scope(spark, d):
    f = table(spark, d, "commit_files").filter("path <> ''").groupBy(F.col("commit_entity_id").alias("entity_id")).agg(F.collect_set("path").alias("ps"))
    return f.select("entity_id", common_scope(F.col("ps")).alias("scope"))


@query("SELECT window_start, event_type, events, value FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)")
def events_per_hour(spark, d):
    from strataloom.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"))
