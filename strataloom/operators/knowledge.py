"""The lifecycle of rules and memories: mining candidates, merging, promotion, exchange as YAML.

Only people promote: candidates become active or rejected by a decision row, an import never
downgrades, and a rejected rule never comes back by mining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.documents import rule_sentences
from strataloom.functions.text import content_key, statement_norm

#: How far a source moves a sentence's confidence, its limits, and the least that is kept.
SHIFT = {"adr": 0.1, "doc": 0.0, "fix": -0.1}
CEILING, FLOOR, LEAST = 0.95, 0.1, 0.4
STATES = {"candidate": 0, "active": 1, "rejected": 2}


def propose(docs: DataFrame, origin: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rule_key, statement, confidence, origin, origin_ref) mined from prose; the best confidence of each statement."""
    found = rule_sentences(docs, key, text)
    confidence = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.round(F.col("confidence") + SHIFT[origin], 2)))
    rows = found.select(content_key("rule", statement_norm(F.col("sentence")), F.lit("")).alias("rule_key"), "sentence", confidence.alias("confidence"), F.col(key).alias("ref")).filter(F.col("confidence") >= LEAST)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "ref", "sentence"))
    return rows.groupBy("rule_key").agg(best.alias("b")).select("rule_key", F.col("b.sentence").alias("statement"), (-F.col("b.c")).alias("confidence"), F.lit(origin).alias("origin"), F.col("b.ref").alias("origin_ref"))


def merge_candidates(rules: DataFrame, proposals: DataFrame) -> DataFrame:
    """Rules with new candidates added; state, confidence and verification of known rules are never touched."""
    known = rules.select("rule_key")
    new = proposals.join(known, "rule_key", "left_anti")
    extra = {c: F.lit(None).cast(dict(rules.dtypes)[c]).alias(c) for c in rules.columns if c not in proposals.columns and c != "state"}
    return rules.unionByName(new.select(*[extra.get(c, F.lit("candidate").alias("state") if c == "state" else F.col(c)) for c in rules.columns]))


def decide(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies people's decisions (rule_key, state, verified_by, verified_at): candidate to active or rejected, never back."""
    d = decisions.select("rule_key", F.col("state").alias("to"), F.col("verified_by").alias("by"), F.col("verified_at").alias("at"))
    moved = rules.join(d, "rule_key", "left")
    take = F.col("to").isin("active", "rejected") & (F.col("state") == "candidate")
    return moved.withColumns({"state": F.when(take, F.col("to")).otherwise(F.col("state")), "verified_by": F.when(take, F.col("by")).otherwise(F.col("verified_by")), "verified_at": F.when(take, F.col("at")).otherwise(F.col("verified_at"))}).select(*rules.columns)


def import_rules(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Imported rules are added or promoted (candidate to active); nothing is downgraded and nothing rejected returns."""
    new = incoming.select("rule_key", F.col("state").alias("in_state"), F.col("statement").alias("in_statement"))
    known = rules.join(new, "rule_key", "left").withColumn("state", F.when((F.col("state") == "candidate") & (F.col("in_state") == "active"), "active").otherwise(F.col("state"))).select(*rules.columns)
    fresh = incoming.join(rules.select("rule_key"), "rule_key", "left_anti")
    return known.unionByName(fresh.select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(dict(rules.dtypes)[c]).alias(c) for c in rules.columns]))


def queue(rules: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates for review, the surest first."""
    from strataloom.functions.ranking import with_rank

    return with_rank(rules.filter("state = 'candidate'"), [], F.col("confidence").desc_nulls_last(), F.col("rule_key"), keep=limit)


def remember(memories: DataFrame, spark: SparkSession, content: str, kind: str = "note", scope: str | None = None, supersedes: int | None = None, pinned: bool = False) -> DataFrame:
    """Memories with one more, keyed by its content; remembering the same again changes nothing."""
    if kind not in ("note", "decision", "preference", "fact"):
        raise ValueError(f"unknown kind {kind!r}")
    row = spark.createDataFrame([(content, kind, scope, supersedes, pinned)], "content string, kind string, scope string, supersedes bigint, pinned boolean")
    key = content_key("mem", statement_norm(F.col("content")), F.col("scope"))
    row = row.withColumn("memory_key", key).withColumn("memory_id", F.abs(F.xxhash64("memory_key")))
    from strataloom.operators.store import insert_absent

    return insert_absent(memories, row.select(*memories.columns), ["memory_key"])
