"""Fusing ranked lists and fitting them into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Damping of reciprocal ranks, weights of the channels, overhead of an item in tokens.
DAMPING = 60
CHANNEL_WEIGHTS = {"code": 1.0, "doc": 0.8, "memory": 0.7, "history": 0.6, "graph": 0.5}
ITEM_OVERHEAD = 4


def reciprocal_ranks(ranked: DataFrame, by: list[str], item: str = "id", source: str = "source", rank: str = "rank", weights: dict[str, float] | None = None) -> DataFrame:
    """(by, item, score, sources): the sum of weight / (DAMPING + rank) over the lists, best first by score then item.

    ``by`` are columns that keep queries apart (may be empty). Sources without a weight count nothing.
    """
    weight: Column = F.lit(1.0)
    if weights is not None:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(source)), F.lit(0.0))
    scored = ranked.select(*by, item, source, (weight / (DAMPING + F.col(rank))).alias("part")).filter("part > 0")
    return scored.groupBy(*by, item).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set(source)).alias("sources"))


def with_rank(df: DataFrame, by: list[str], *order: Column, name: str = "rank", keep: int | None = None) -> DataFrame:
    """Ranks from 1 inside ``by``; the order must be total. ``keep`` prunes before the shuffle (window group limit).

    A rank over everything with ``keep`` takes the first rows by a distributed top-k and numbers only these.
    """
    if keep and not by:
        df = df.orderBy(*order).limit(keep)
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out.filter(F.col(name) <= keep) if keep else out


def item_cost(title: Column, snippet: Column, ref: Column) -> Column:
    part = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    return (part(title) + part(snippet) + part(ref) + ITEM_OVERHEAD).cast("int")


def pack(items: DataFrame, by: list[str], budget: int, key: str = "key", cost: str = "cost", rank: str = "rank", pinned: str = "pinned") -> DataFrame:
    """(by, key, taken, tokens_after): pinned items always, then greedily every item that still fits, in rank order.

    A fold over the ranked items of one request (a shortlist by construction), not a running sum:
    an item that is too large is skipped and smaller ones behind it may still go in.
    """
    entry = F.struct((~F.col(pinned)).alias("later"), F.col(rank).alias("rank"), F.col(key).alias("key"), F.col(cost).cast("long").alias("cost"))
    listed = items.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("list"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<key:string,taken:boolean,tokens_after:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        takes = ~x["later"] | (acc["used"] + x["cost"] <= budget)
        used = F.when(takes, acc["used"] + x["cost"]).otherwise(acc["used"])
        row = F.struct(x["key"].cast("string").alias("key"), takes.alias("taken"), used.alias("tokens_after"))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = listed.select(*by, F.aggregate("list", empty, step).alias("f"))
    return folded.select(*by, F.explode("f.out").alias("o")).select(*by, "o.key", "o.taken", "o.tokens_after")
