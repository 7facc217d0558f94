"""Lexical and vector search, and their fusion.

The lexical score is ours: every query word must occur; a word scores its best field
weight (name or heading 1, documentation or content 0.4, body 0.2) times tf / (1 + tf),
summed over the words. Order is by score, then id, so every limit is total.

Queries are a DataFrame (query_id, ...): one plan answers all of them. Words and vectors
meet the rows by equi-joins (word, project), never by a cross join of queries and rows
beyond a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.ranking import reciprocal_ranks, with_rank
from strataloom.functions.text import tokens
from strataloom.functions.vectors import dot, usable

FIELD_WEIGHTS = {"name": 1.0, "doc": 0.4, "body": 0.2}


def inverted_index(rows: DataFrame, key: str, fields: dict[str, float], *keep: str, words: DataFrame | None = None) -> DataFrame:
    """(keep, key, token, weight): the best over the fields of weight x tf / (1 + tf).

    With ``words`` (keep, token) only these tokens are counted: the others are dropped by a semi-join where
    they are read, so what is shuffled is what the queries ask for.
    """
    parts = None
    for column, weight in fields.items():
        one = rows.select(*keep, key, F.explode(tokens(F.col(column))).alias("token"))
        if words is not None:
            one = one.join(words.select(*keep, "token").distinct(), [*keep, "token"], "left_semi")
        one = one.groupBy(*keep, key, "token").agg((F.lit(weight) * F.count("*") / (1.0 + F.count("*"))).alias("weight"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*keep, key, "token").agg(F.max("weight").alias("weight"))


def query_words(queries: DataFrame, on: list[str]) -> DataFrame:
    return queries.select("query_id", *on, F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("token"))


def lexical(index: DataFrame, queries: DataFrame, key: str, on: list[str], limit: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): rows that hold every word of the query. ``on`` are columns shared by both, such as the project."""
    words = query_words(queries, on)
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = index.join(words, [*on, "token"]).groupBy("query_id", key).agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").alias("n"))
    found = hits.join(need, "query_id").filter("n = need").select("query_id", key, "score")
    return with_rank(found, ["query_id"], F.col("score").desc(), F.col(key), keep=limit)


def lexical_search(rows: DataFrame, queries: DataFrame, key: str, fields: dict[str, float], on: list[str], limit: int | None = None) -> DataFrame:
    """``lexical`` over an index of just the words that are asked for."""
    return lexical(inverted_index(rows, key, fields, *on, words=query_words(queries, on)), queries, key, on, limit)


def nearest(rows: DataFrame, queries: DataFrame, key: str, on: list[str], limit: int, dim: int = 64) -> DataFrame:
    """(query_id, key, score, rank): exact cosine top ``limit`` among the rows that share ``on`` with the query."""
    norm = lambda v: F.sqrt(dot(v, v))
    left = rows.select(*on, key, usable(F.col("embedding"), dim).alias("v")).filter("v IS NOT NULL").withColumn("vn", norm(F.col("v")))
    right = queries.select("query_id", *on, usable(F.col("embedding"), dim).alias("q")).filter("q IS NOT NULL").withColumn("qn", norm(F.col("q")))
    pairs = left.join(right, on)
    scored = pairs.select("query_id", key, F.round(dot(F.col("v"), F.col("q")) / (F.col("vn") * F.col("qn")), 6).alias("score"))
    return with_rank(scored, ["query_id"], F.col("score").desc(), F.col(key), keep=limit)


def fuse(lists: dict[str, DataFrame], key: str, limit: int) -> DataFrame:
    """(query_id, key, score, sources, rank): reciprocal rank fusion of ranked lists."""
    union = None
    for source, df in lists.items():
        one = df.select("query_id", key, F.lit(source).alias("source"), "rank")
        union = one if union is None else union.unionByName(one)
    fused = reciprocal_ranks(union, ["query_id"], key).withColumn("score", F.round("score", 6))
    return with_rank(fused, ["query_id"], F.col("score").desc(), F.col(key), keep=limit)


def pool_size(limit: int) -> int:
    """How many candidates each list gives before fusion."""
    return max(5 * limit, 50)


#: Fields of a document chunk and of a memory with their weights.
CHUNK_WEIGHTS, MEMORY_WEIGHTS = {"heading_path": 1.0, "content": 0.4}, {"content": 1.0}


def search_code(symbols: DataFrame, queries: DataFrame, limit: int = 10, with_vectors: bool = True) -> DataFrame:
    """Hybrid search over a project's symbols: (query_id, symbol_id, score, sources, rank).

    ``with_vectors`` only if the queries' vectors come from the embedder that made the column; else the vector
    list would be noise of full weight.
    """
    rows = symbols.filter("id IS NOT NULL").withColumn("symbol_id", F.col("id"))
    lists = {"fts": lexical_search(rows, queries, "symbol_id", FIELD_WEIGHTS, ["project_id"], pool_size(limit))}
    if with_vectors:
        lists["vector"] = nearest(rows, queries, "symbol_id", ["project_id"], pool_size(limit))
    return fuse(lists, "symbol_id", limit)


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents that exist, with the document's title and type; chunks of deleted ones are out."""
    about = documents.select(F.col("doc_id").alias("entity_id"), "title", "doc_type")
    return chunks.filter("id IS NOT NULL").join(about, "entity_id")


def search_knowledge(symbols: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 10, memories: DataFrame | None = None, with_vectors: bool = True) -> DataFrame:
    """Lists over ``sym:``, ``chunk:`` and, if given, ``mem:`` ids: (query_id, item, score, sources, rank). Superseded memories are out."""
    pool = pool_size(limit)
    sym = symbols.filter("id IS NOT NULL").withColumn("item", F.concat(F.lit("sym:"), F.col("id").cast("string")))
    chunk = chunks.filter("id IS NOT NULL").withColumn("item", F.concat(F.lit("chunk:"), F.col("id").cast("string")))
    lists = {"code_fts": lexical_search(sym, queries, "item", FIELD_WEIGHTS, ["project_id"], pool), "doc_fts": lexical_search(chunk, queries, "item", CHUNK_WEIGHTS, ["project_id"], pool)}
    if with_vectors:
        lists |= {"code_vector": nearest(sym, queries, "item", ["project_id"], pool), "doc_vector": nearest(chunk, queries, "item", ["project_id"], pool)}
    if memories is not None:
        alive = memories.join(memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id")), "memory_id", "left_anti")
        lists["memory_fts"] = lexical_search(alive.withColumn("item", F.concat(F.lit("mem:"), F.col("memory_id").cast("string"))), queries, "item", MEMORY_WEIGHTS, ["project_id"] if "project_id" in memories.columns else [], pool)
    return fuse(lists, "item", limit)


def related(vectors: DataFrame, seeds: DataFrame, key: str, group: str, limit: int = 5, dim: int = 64) -> DataFrame:
    """(seed, key, score, rank): the most similar others of the same group for each seed row (the seeds are a stated set)."""
    queries = seeds.select(F.col(key).alias("query_id"), group, "embedding")
    near = nearest(vectors, queries, key, [group], limit + 1, dim).filter(F.col("query_id") != F.col(key)).drop("rank")
    return with_rank(near, ["query_id"], F.col("score").desc(), F.col(key), keep=limit).withColumnRenamed("query_id", "seed")


def recall(memories: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Pinned memories first (no score), then the fused ones; superseded ones are out, each memory once by its best chunk.

    ``memories``: memory_id, pinned, supersedes; ``ranked``: memory_id, score.
    """
    alive = memories.join(memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id")), "memory_id", "left_anti")
    best = ranked.groupBy("memory_id").agg(F.max("score").alias("score"))
    rows = alive.join(best, "memory_id", "left").filter("pinned OR score IS NOT NULL").select("memory_id", F.col("pinned").alias("pinned"), F.when(~F.col("pinned"), F.col("score")).alias("score"))
    return with_rank(rows, [], F.col("pinned").desc(), F.col("score").desc_nulls_last(), F.col("memory_id"), keep=limit)


def snippet(text: Column, chars: int = 600) -> Column:
    return F.substring(text, 1, chars)
