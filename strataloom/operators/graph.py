"""Symbols and the calls between them: edges, resolution of names, neighbours, bounded search, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import cut

#: Words before a bracket that are no calls.
NOT_CALLS = "if for while switch catch return function def class elif with and or not in except print assert lambda yield func go defer range typeof sizeof array isset empty unset list echo super foreach raise throw new match".split()
NODE_CAP = 60


class UnknownTarget(LookupError):
    """A name that the project does not have; an empty result never means a typing slip."""


def require(df: DataFrame, what: str) -> DataFrame:
    if df.limit(1).isEmpty():
        raise UnknownTarget(what)
    return df


def suffixes(name: Column) -> Column:
    """The name and its part after the last ``::``: keys that turn a suffix match into an equi-join."""
    return F.array_distinct(F.array(name, F.regexp_replace(name, r"^.*::", "")))


def names_match(name: Column, wanted: str) -> Column:
    """Exact or ``::``-suffix, literally."""
    return (name == wanted) | F.endswith(name, F.lit("::" + wanted))


def call_edges(symbols: DataFrame) -> DataFrame:
    """(project_id, src, file_id, dst_name, relation): what each body calls (CALLS) or creates (INSTANTIATES), once each."""
    body = F.coalesce("body", F.lit(""))
    calls = F.regexp_extract_all(body, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    made = F.regexp_extract_all(body, F.lit(r"\bnew\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    own = F.regexp_replace("name", r"^.*::", "")
    rows = symbols.filter("id IS NOT NULL AND body IS NOT NULL").select("project_id", F.col("id").alias("src"), "file_id", own.alias("own"), made.alias("made"), F.explode(F.array_distinct(calls)).alias("dst_name"))
    relation = F.when(F.array_contains("made", F.col("dst_name")), "INSTANTIATES").otherwise("CALLS")
    return rows.filter((F.col("dst_name") != F.col("own")) & ~F.col("dst_name").isin(*NOT_CALLS)).select("project_id", "src", "file_id", "dst_name", relation.alias("relation"))


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with ``dst``: exact name, then ``::`` suffix, then without a leading backslash, then a short name that is unique.

    Four equi-joins on computed keys, each against one row per key; the first that hits counts.
    """
    s = symbols.filter("id IS NOT NULL AND name IS NOT NULL").select("project_id", "id", "name")
    exact = s.groupBy("project_id", F.col("name").alias("k")).agg(F.min("id").alias("d1"))
    tail = s.filter(F.contains("name", F.lit("::"))).groupBy("project_id", F.regexp_replace("name", r"^.*::", "").alias("k")).agg(F.min("id").alias("d2"))
    short = s.groupBy("project_id", F.regexp_replace("name", r"^.*\\", "").alias("k")).agg(F.min("id").alias("d4"), F.count("*").alias("n")).filter("n = 1").drop("n")
    bare = F.regexp_replace("dst_name", r"^\\+", "")
    out = edges.withColumn("k", F.col("dst_name")).join(exact, ["project_id", "k"], "left").join(tail, ["project_id", "k"], "left").drop("k")
    out = out.withColumn("k", bare).join(exact.withColumnRenamed("d1", "d3"), ["project_id", "k"], "left").drop("k")
    out = out.withColumn("k", F.regexp_replace("dst_name", r"^.*\\", "")).join(short, ["project_id", "k"], "left").drop("k")
    return out.withColumn("dst", F.coalesce("d1", "d2", "d3", "d4")).drop("d1", "d2", "d3", "d4")


def neighbours(resolved: DataFrame, symbols: DataFrame, files: DataFrame, inbound: bool) -> DataFrame:
    """Callers (inbound) or callees of every symbol, with where they stand; unresolved callees keep their raw name."""
    here, there = ("dst", "src") if inbound else ("src", "dst")
    other = symbols.select(F.col("id").alias(there), F.col("name").alias("other_name"), F.col("file_id").alias("other_file"))
    place = files.select(F.col("id").alias("other_file"), F.col("path").alias("other_path"))
    rows = resolved.filter(F.col(here).isNotNull()).join(other, there, "left").join(place, "other_file", "left")
    return rows.select("project_id", F.col(here).alias("symbol_id"), "relation", F.coalesce("other_name", "dst_name" if not inbound else F.lit("@file")).alias("other"), "other_path").distinct()


def hubs(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, symbol_id, name, inbound, outbound): two aggregations instead of correlated counts."""
    incoming = resolved.filter("dst IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    outgoing = resolved.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outbound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return symbols.select("project_id", "id", "name").join(incoming, "id", "left").join(outgoing, "id", "left").select("project_id", F.col("id").alias("symbol_id"), "name", zero("inbound"), zero("outbound"))


def subgraph(resolved: DataFrame, seeds: DataFrame, depth: int = 2, cap: int = NODE_CAP) -> DataFrame:
    """(seed, id, depth): symbols within ``depth`` (at most 4) hops of each seed in either direction, the nearest ``cap`` by (depth, id).

    The links are written once and every hop is written before the next, so the plan of a hop does not hold the
    hops and the resolution before it. Each hop is an equi-join in place of a join on an OR.
    """
    both = resolved.filter("dst IS NOT NULL AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = frontier = cut(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")))
    for hop in range(1, min(max(depth, 1), 4) + 1):
        reached = frontier.join(both, frontier["id"] == both["a"]).select("seed", F.col("b").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = cut(reached.withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    nearest = Window.partitionBy("seed").orderBy("depth", "id")
    return seen.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= cap).drop("r")


def subgraph_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, src, dst, relation, dst_name, inside): edges that leave the nodes of each subgraph, also to symbols that its cap left out and to names that are no symbol."""
    out = resolved.select("src", "dst", "relation", "dst_name").join(nodes.select("seed", F.col("id").alias("src")), "src")
    ends = nodes.select("seed", F.col("id").alias("dst"), F.lit(True).alias("inside"))
    return out.join(ends, ["seed", "dst"], "left").select("seed", "src", "dst", "relation", "dst_name", F.coalesce("inside", F.lit(False)).alias("inside")).distinct()


def outline(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The symbols of every file in order of their lines."""
    order = Window.partitionBy("file_id").orderBy(F.col("start_line").asc_nulls_last(), "id")
    rows = symbols.select("file_id", F.col("id").alias("symbol_id"), "name", "kind", "signature", "start_line", "end_line", "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.withColumn("ord", F.row_number().over(order)).select("file_id", "path", "ord", "symbol_id", "name", "kind", "signature", "start_line", "end_line")


def hierarchy_depth(paths: DataFrame) -> DataFrame:
    """The deepest root that contains each directory: (dir, root)."""
    return paths.filter((F.col("dir") == F.col("root")) | F.startswith("dir", F.concat("root", F.lit("/")))).groupBy("dir").agg(F.max_by("root", F.length("root")).alias("root"))
