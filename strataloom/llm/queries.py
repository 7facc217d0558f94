"""The pN_ queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.catalog import table
from strataloom.llm import author_names, bpe_automaton, code_docs, contamination, cooccurrence, mojibake, outranking, source_origin, vector_neighbors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods whose documentation says something."""
    return code_docs.pairs_with_documentation(table(spark, sf_dir, "symbols"), columns=("symbol_id",))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and description pairs themselves."""
    return code_docs.pairs_with_documentation(table(spark, sf_dir, "symbols"))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs taken from the files themselves by a parse that recovers from errors."""
    return code_docs.pairs_in_files(table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of authors that are one person, team or bot."""
    return author_names.author_pairs(author_names.link_authors(table(spark, sf_dir, "commits"), table(spark, sf_dir, "projects")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar of the other, by cosine >= 0.9."""
    parts = []
    for kind, name in (("symbol", "symbols"), ("chunk", "chunks")):
        near = vector_neighbors.nearest_neighbors(table(spark, sf_dir, name), "id", "embedding", 5, 0.9)
        parts.append(vector_neighbors.neighbor_pairs(near).select(F.lit(kind).alias("kind"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, vendored or data kept as code."""
    return source_origin.file_origins(table(spark, sf_dir, "files")).select("file_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path pairs with pair >= 4 and lift >= 3."""
    pairs = cooccurrence.commit_cooccurrence(table(spark, sf_dir, "commits"), table(spark, sf_dir, "commit_files"), 4, 50)
    return pairs.filter("pair * n >= 3 * a * b").select("project_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p6_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cochange should hold now: every pair seen twice or more, with its statistics."""
    pairs = cooccurrence.commit_cooccurrence(table(spark, sf_dir, "commits"), table(spark, sf_dir, "commit_files"), 2, 50)
    return pairs.select(
        "project_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), F.col("pair").alias("pair_commits"), F.col("a").alias("a_commits"), F.col("b").alias("b_commits"),
        F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"),
    )


_P6 = """
WITH plain AS (SELECT entity_id, project_id, sha FROM commits WHERE NOT coalesce(is_merge, false)),
n AS (SELECT project_id, count(DISTINCT sha) AS n FROM plain GROUP BY 1),
m AS (SELECT DISTINCT p.project_id, p.sha, f.path FROM commit_files f JOIN plain p ON p.entity_id = f.commit_entity_id WHERE f.path <> ''),
c AS (SELECT project_id, path, count(*) AS c FROM m GROUP BY 1, 2),
small AS (SELECT project_id, sha FROM m GROUP BY 1, 2 HAVING count(*) <= 50),
k AS (SELECT m.* FROM m JOIN small USING (project_id, sha)),
p AS (SELECT x.project_id, x.path AS path_a, y.path AS path_b, count(*) AS pair FROM k x JOIN k y ON x.project_id = y.project_id AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3),
s AS (SELECT p.*, a.c AS a, b.c AS b, n.n FROM p JOIN c a ON a.project_id = p.project_id AND a.path = p.path_a JOIN c b ON b.project_id = p.project_id AND b.path = p.path_b JOIN n ON n.project_id = p.project_id)
"""
P6_FOUND_SQL = _P6 + "SELECT project_id, path_a, path_b FROM s WHERE pair >= 4 AND pair * n >= 3 * a * b"
P6_COCHANGE_SQL = _P6 + """
SELECT project_id, path_a, path_b, pair AS pair_commits, a AS a_commits, b AS b_commits, round(pair / CAST(least(a, b) AS DOUBLE), 6) AS confidence,
  round(pair * n / CAST(a * b AS DOUBLE), 6) AS lift, round(log2(pair * n / CAST(a * b AS DOUBLE)), 6) AS pmi FROM s WHERE pair >= 2"""


def _ranked(spark: SparkSession, sf_dir: str, flows: bool) -> DataFrame:
    scores = outranking.query_scores(table(spark, sf_dir, "search_queries"), table(spark, sf_dir, "symbols"))
    return outranking.ranked_scores(scores, ["query_id"], "symbol_id", {"text": 1.0, "vector": 1.0}, flows)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are in place 8 or better in both scores, every query's in the order of the ranking by net flow."""
    found = _ranked(spark, sf_dir, True).filter("place_text <= 8 AND place_vector <= 8")
    return found.orderBy("query_id", F.round("net_flow", 9).desc(), "symbol_id").select("query_id", "symbol_id")


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best symbols of every query by net flow."""
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.round("net_flow", 9).desc(), "symbol_id")
    top = _ranked(spark, sf_dir, True).withColumn("rank", F.row_number().over(best)).filter("rank <= 10")
    return top.select("query_id", "rank", "symbol_id", "place_text", "place_vector", F.round("net_flow", 6).alias("net_flow"))


#: The preference by its definition, for every pair.
_PREFERS = f"least(greatest(({{}} - {outranking.INDIFFERENCE}) / ({outranking.PREFERENCE} - {outranking.INDIFFERENCE}), 0), 1)"
_P7 = """
WITH q AS (SELECT query_id, project_id, list_filter(string_split(lower(coalesce(query_text, '')), ' '), lambda w: w <> '') AS words, embedding FROM search_queries),
s AS (SELECT id AS symbol_id, project_id, coalesce(fts_vector, '') AS fts, embedding FROM symbols),
u AS (SELECT *, CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM s),
w AS (SELECT *, CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS qv FROM q),
words AS (SELECT query_id, project_id, unnest(words) AS word FROM w),
entries AS (SELECT symbol_id, project_id, unnest(string_split(fts, ' ')) AS entry FROM u),
hits AS (SELECT x.query_id, e.symbol_id, sum(10 * (length(p) - length(replace(p, 'A', ''))) + 4 * (length(p) - length(replace(p, 'B', ''))) + 2 * (length(p) - length(replace(p, 'C', '')))) AS text
  FROM words x JOIN (SELECT symbol_id, project_id, string_split(entry, ''':')[1] AS t, string_split(entry, ''':')[2] AS p FROM entries WHERE entry <> '') e ON e.project_id = x.project_id AND e.t = '''' || x.word GROUP BY 1, 2),
pairs AS (SELECT w.query_id, u.symbol_id, coalesce(h.text, 0) AS text, CASE WHEN u.v IS NOT NULL AND w.qv IS NOT NULL THEN list_sum(list_transform(list_zip(u.v, w.qv), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(u.v, lambda z: z * z))) * sqrt(list_sum(list_transform(w.qv, lambda z: z * z)))) END AS vector
  FROM w JOIN u ON u.project_id = w.project_id LEFT JOIN hits h ON h.query_id = w.query_id AND h.symbol_id = u.symbol_id),
places AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY text DESC NULLS LAST) AS place_text, rank() OVER (PARTITION BY query_id ORDER BY vector DESC NULLS LAST) AS place_vector FROM pairs)
"""
P7_FOUND_SQL = _P7 + "SELECT query_id, symbol_id FROM places WHERE place_text <= 8 AND place_vector <= 8"
P7_RANKING_SQL = _P7 + """,
per AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM places),
pct AS (SELECT *, CASE WHEN n > 1 THEN (n - place_text) / CAST(n - 1 AS DOUBLE) ELSE 1.0 END AS pt, CASE WHEN n > 1 THEN (n - place_vector) / CAST(n - 1 AS DOUBLE) ELSE 1.0 END AS pv FROM per),
tt AS (SELECT query_id, pt AS y, count(*) AS c FROM pct GROUP BY 1, 2), tv AS (SELECT query_id, pv AS y, count(*) AS c FROM pct GROUP BY 1, 2),
ft AS (SELECT a.query_id, a.y, sum(b.c * (""" + _PREFERS.format("a.y - b.y") + " - " + _PREFERS.format("b.y - a.y") + """)) AS f FROM tt a JOIN tt b USING (query_id) GROUP BY 1, 2),
fv AS (SELECT a.query_id, a.y, sum(b.c * (""" + _PREFERS.format("a.y - b.y") + " - " + _PREFERS.format("b.y - a.y") + """)) AS f FROM tv a JOIN tv b USING (query_id) GROUP BY 1, 2),
flow AS (SELECT pct.*, (ft.f + fv.f) / 2 / greatest(n - 1, 1) AS net FROM pct JOIN ft ON ft.query_id = pct.query_id AND ft.y = pct.pt JOIN fv ON fv.query_id = pct.query_id AND fv.y = pct.pv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(net, 9) DESC, symbol_id) AS rank FROM flow)
SELECT query_id, CAST(rank AS INTEGER) AS rank, symbol_id, place_text, place_vector, round(net, 6) AS net_flow FROM r WHERE rank <= 10"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return bpe_automaton.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item's own wording."""
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: in how many documents it stands and the largest share found."""
    found = contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 4).alias("largest_share"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one passage garbled by a wrong decoding."""
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents' texts, restored as far as the corpus can tell."""
    return mojibake.restored_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p1_sources": p1_sources,
        "p2_found": p2_found,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_cochange": p6_cochange,
        "p7_found": p7_found,
        "p7_ranking": p7_ranking,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p9_report": p9_report,
        "p10_found": p10_found,
        "p10_restored": p10_restored,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": P6_FOUND_SQL,
        "p6_cochange": P6_COCHANGE_SQL,
        "p7_found": P7_FOUND_SQL,
        "p7_ranking": P7_RANKING_SQL,
    }
