"""One ranking from several differently-scaled scores (problem 3)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import hot_keys, parted, ranked_by_range
from . import common

K = 60
#: Queries with more hits than this are ranked by value ranges; the number does not grow with the data.
HOT_ROWS = 200_000


def _merged(hits: DataFrame, query: str, item: str, scores: list[str]) -> DataFrame:
    """One row per query and item with its best value of each score."""
    return hits.groupBy(query, item).agg(*[F.max(common.measured(F.col(s).cast("double"))).alias(s) for s in scores])


def _share(rank: Column, k: int) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def fuse_scores(hits: DataFrame, query: str, item: str, scores: list[str], k: int = K, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reciprocal rank fusion: (query, item, total). Each score ranks the items by itself; an item gets the sum of 1 / (k + rank).

    Only the order within each score enters, so units, spread and outliers weigh nothing. Equal values share a
    rank. A score that an item lacks (null or not a number) adds nothing to it, and one that the query lacks
    altogether adds nothing to anyone. An item that comes several times in a query, from whichever part, counts
    once with the best value of each score; an item without any score keeps total 0. Rows without query or item
    are left out. Empty tables give no rows.

    Queries of ordinary size take one shuffle by query that serves merging and all rankings. Hot queries are merged by
    (query, item) and ranked by ranges of (query, score, value) instead, equal values in parts; both ways give the same
    total to the last bit.
    """
    rows = hits.filter(F.col(query).isNotNull() & F.col(item).isNotNull()).select(query, item, *scores)
    hot = hot_keys(rows.select(query), query, hot_rows)
    usual, hits_of_hot = parted(rows, hot, query)
    merged = _merged(usual.repartition(query), query, item, scores)

    def place(s: str) -> Column:
        rank = F.rank().over(Window.partitionBy(query).orderBy(F.col(s).desc_nulls_last()))
        return F.when(F.col(s).isNotNull(), _share(rank, k)).otherwise(F.lit(0.0))

    ranked = merged.select(query, item, *[place(s).alias(f"_{i}") for i, s in enumerate(scores)])
    total = reduce(add, [F.col(f"_{i}") for i in range(len(scores))])
    out = ranked.select(query, item, F.round(total, 12).alias("total"))
    if hits_of_hot is None:
        return out
    big = _merged(hits_of_hot, query, item, scores)
    legs = big.select(query, item, F.posexplode(F.array(*scores)).alias("_leg", "_v"))
    placed = ranked_by_range(legs.filter("_v is not null"), [query, "_leg"], "_v", "_rank")
    # summed in the order of the scores, as above, so that both ways give the same total to the last bit
    parts = placed.unionByName(legs.filter("_v is null").withColumn("_rank", F.lit(None).cast("long"))).groupBy(query, item)
    sums = parts.agg(*[F.coalesce(F.max(F.when(F.col("_leg") == i, _share(F.col("_rank"), k))), F.lit(0.0)).alias(f"_{i}") for i in range(len(scores))])
    return out.unionByName(sums.select(query, item, F.round(total, 12).alias("total")))


def first_items(fused: DataFrame, query: str, item: str, n: int) -> DataFrame:
    """The ``n`` items of highest total per query with their place; equal totals go to the smaller item."""
    w = Window.partitionBy(query).orderBy(F.col("total").desc(), F.col(item))
    return fused.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
