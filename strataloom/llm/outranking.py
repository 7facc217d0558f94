"""One ranking from several differently scaled scores by outranking net flow.

Each score is turned into places and percentiles inside its group, so no scale
decides alone. Per score, i is preferred to j by a function of the difference d of
their percentiles: not at all up to ``INDIFFERENCE``, fully from ``PREFERENCE`` on, and
linearly between. The flow of i is the weighted sum of the preferences it has over
others minus those others have over it, over n - 1.

Both sums come exactly from sorted prefix sums N(t), the number of percentiles up to t,
and M(t), their sum: with q and p the thresholds, i at percentile x has
N(x-p) + ((x-q) (N(x-q) - N(x-p)) - M(x-q) + M(x-p)) / (p-q) over others, and the like
above it. The four places at which i looks N and M up are sorted in between the percentiles.

The prefix sums are taken in two levels: equal scores are first combined into
one tie group with its count (map-side), tie groups fall into ``buckets`` of about
equal number (by approximate quantiles of the score, then by percentile), bucket
totals are summed over at most ``buckets`` rows, and tie groups only inside their
bucket. So no task holds a whole group, however large it is or however skewed its scores.

Defined results: a null or not finite score is below all others; ties share a
place (1 + the number of strictly higher scores) and a percentile; a group of
one item has flow 0; null group or item rows are ignored; repeated
(group, item) rows are a caller's error and count as items of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.vectors import dot, usable
from strataloom.session import cut

#: Differences of percentiles that mean nothing, and that mean all.
INDIFFERENCE, PREFERENCE = 0.02, 0.25


def _value(score: str) -> Column:
    v = F.col(score).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v + F.lit(0.0))


def _running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` (with a column bucket) and, per name, the sum of the column over all rows before in (bucket, order), in two levels."""
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*group, "bucket").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    whole = whole.select(*group, "bucket", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    joined = rows.join(whole, [*group, "bucket"])
    return joined.select(*rows.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()])


def score_places(scores: DataFrame, group: list[str], score: str, buckets: int = 256) -> DataFrame:
    """Tie groups of one score: group columns, value (null: lowest), c and n (numbers of the tie and the group), place, percentile."""
    ties = scores.select(*group, _value(score).alias("value")).groupBy(*group, "value").agg(F.count("*").alias("c"))
    cuts = F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 4 * buckets)
    groups = ties.groupBy(*group).agg(F.sum("c").alias("n"), cuts.alias("cuts"))
    # The highest scores come first; what has no value comes last.
    bucket = F.when(F.col("value").isNull(), buckets).otherwise(F.size(F.filter("cuts", lambda x: x > F.col("value"))))
    placed = ties.join(groups, group).withColumn("bucket", bucket).drop("cuts")
    ranked = _running(placed, group, [F.col("value").desc_nulls_last()], {"higher": F.col("c")})
    percentile = F.when(F.col("n") > 1, (F.col("n") - F.col("place")) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return ranked.withColumn("place", 1 + F.col("higher")).select(*group, "value", "c", "n", "place", percentile.alias("percentile"))


def preference_flows(places: DataFrame, group: list[str], indifference: float = INDIFFERENCE, preference: float = PREFERENCE, buckets: int = 256) -> DataFrame:
    """``places`` (see ``score_places``) with flow_plus and flow_minus."""
    q, p = indifference, preference
    asked = F.array(*[F.struct(F.lit(k).alias("ask"), (F.col("percentile") + d).alias("at")) for k, d in enumerate((-p, -q, q, p))])
    keep = [*group, "value", "c", "n", "place", "percentile"]
    stand = places.select(*keep, F.lit(-1).alias("ask"), F.col("percentile").alias("at"))
    asks = places.select(*keep, F.explode(asked).alias("a")).select(*keep, "a.ask", "a.at")
    own = F.when(F.col("ask") < 0, F.col("c")).otherwise(0)
    bucket = F.least(F.greatest(F.floor(F.col("at") * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    # A percentile counts for those who ask at it; there its part is the same by either rule.
    found = _running(stand.unionByName(asks).withColumn("bucket", bucket), group, [F.col("at"), F.col("ask")], {"upto": own, "mass": own * F.col("percentile")})
    at = lambda name, k: F.max(F.when(F.col("ask") == k, F.col(name)))
    wide = found.filter("ask >= 0").groupBy(*keep).agg(*[at(s, k).alias(f"{s}{k}") for k in range(4) for s in ("upto", "mass")])
    x, others = F.col("percentile"), F.greatest(F.col("n") - 1, F.lit(1))
    plus = F.col("upto0") + ((x - q) * (F.col("upto1") - F.col("upto0")) - (F.col("mass1") - F.col("mass0"))) / (p - q)
    minus = F.col("n") - F.col("upto3") + ((F.col("mass3") - F.col("mass2")) - (x + q) * (F.col("upto3") - F.col("upto2"))) / (p - q)
    return wide.select(*keep, (plus / others).alias("flow_plus"), (minus / others).alias("flow_minus"))


def ranked_scores(scores: DataFrame, group: list[str], item: str, weights: dict[str, float], flows: bool = True, buckets: int = 256) -> DataFrame:
    """All rows of ``scores`` with place_S and percentile_S per score S, and net_flow over all scores if ``flows``.

    ``weights`` names the score columns; they are divided by their sum.
    """
    whole = sum(weights.values())
    keys = reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in [*group, item]))
    out = cut(scores.filter(keys).select(*group, item, *weights))  # the scores are dear and read once per score and again for the join
    base = out
    flow = F.lit(0.0)
    for k, (score, weight) in enumerate(weights.items()):
        ties = score_places(base, group, score, buckets)
        if flows:
            ties = preference_flows(ties, group, buckets=buckets).withColumn(f"__flow{k}", F.col("flow_plus") - F.col("flow_minus"))
            flow = flow + F.lit(weight / whole) * F.col(f"__flow{k}")
        extra = [f"__flow{k}"] if flows else []
        ties = ties.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("value").alias("__v"), F.col("place").alias(f"place_{score}"), F.col("percentile").alias(f"percentile_{score}"), *extra)
        on = [F.col(g) == F.col(f"__g{i}") for i, g in enumerate(group)] + [_value(score).eqNullSafe(F.col("__v"))]
        out = out.join(ties, reduce(lambda a, b: a & b, on)).drop(*[f"__g{i}" for i in range(len(group))], "__v")
    if not flows:
        return out
    return out.withColumn("net_flow", flow).drop(*[f"__flow{k}" for k in range(len(weights))])


def net_flow_ranking(scores: DataFrame, group: list[str], item: str, weights: dict[str, float], buckets: int = 256) -> DataFrame:
    """``ranked_scores`` with flows."""
    return ranked_scores(scores, group, item, weights, True, buckets)


def text_score(fts: Column, words: Column) -> Column:
    """Tenths: sum over words of the word's positions in a tsvector text, A 10, B 4, C 2."""

    def one(word):
        key = F.concat(F.lit("'"), word, F.lit("':"))
        at = F.instr(fts, key)
        seg = F.when(at > 0, F.substring_index(F.substring(fts, at + F.length(key), F.length(fts)), " ", 1)).otherwise(F.lit(""))
        count = lambda letter: F.length(seg) - F.length(F.translate(seg, letter, ""))
        return 10 * count("A") + 4 * count("B") + 2 * count("C")

    return F.aggregate(words, F.lit(0), lambda acc, w: acc + one(w))


def query_scores(queries: DataFrame, symbols: DataFrame, dim: int = 64) -> DataFrame:
    """(query_id, symbol_id, text, vector) for every symbol of the query's project; vector is null if unusable.

    The queries join by project, so a query meets only its project's rows; Spark broadcasts the queries
    only below its size threshold and else shuffles, where AQE splits a project that is hot.
    """
    q = queries.filter("query_id IS NOT NULL AND project_id IS NOT NULL").select(
        "query_id", "project_id", F.filter(F.split(F.lower(F.coalesce("query_text", F.lit(""))), r"\s+"), lambda w: w != "").alias("words"), usable(F.col("embedding"), dim).alias("qv")
    )
    q = q.withColumn("qn", F.sqrt(dot(F.col("qv"), F.col("qv"))))
    s = symbols.filter("id IS NOT NULL AND project_id IS NOT NULL").select(F.col("id").alias("symbol_id"), "project_id", F.coalesce("fts_vector", F.lit("")).alias("fts"), usable(F.col("embedding"), dim).alias("sv"))
    s = s.withColumn("sn", F.sqrt(dot(F.col("sv"), F.col("sv"))))
    return s.join(q, "project_id").select("query_id", "symbol_id", text_score(F.col("fts"), F.col("words")).alias("text"), (dot(F.col("sv"), F.col("qv")) / (F.col("sn") * F.col("qn"))).alias("vector"))
