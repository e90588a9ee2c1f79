"""Ranking metrics per query, as joins of two ranked lists.

Lists have query_id, doc_id and rank (1-based). Queries without rows are kept by joining from ``queries``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log2_gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def _shared(lists: DataFrame, truth: DataFrame) -> DataFrame:
    return lists.select("query_id", "doc_id", F.col("rank").alias("rc")).join(truth.select("query_id", "doc_id", F.col("rank").alias("ro")), ["query_id", "doc_id"])


def _kept(queries: DataFrame, got: DataFrame, empty: dict[str, float]) -> DataFrame:
    return queries.select("query_id").join(got, "query_id", "left").fillna(empty)


def ndcg(queries: DataFrame, lists: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Gain of a document: 1 / log2(rank in the whole truth list + 1). Empty truth or k below 1 gives 0."""
    dcg = _shared(lists.filter(F.col("rank") <= k), truth).groupBy("query_id").agg(F.sum(_log2_gain(F.col("ro")) * _log2_gain(F.col("rc"))).alias("dcg"))
    ideal = truth.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_log2_gain(F.col("rank")) * _log2_gain(F.col("rank"))).alias("ideal"))
    both = ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))
    return _kept(queries, both, {"ndcg": 0.0})


def judged_ndcg(queries: DataFrame, lists: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Gain 2**grade - 1; the ideal list is made of all judged documents of the query. No judgments give 0, unjudged hits gain nothing."""
    gain = F.pow(F.lit(2.0), F.col("grade").cast("double")) - F.lit(1.0)
    best = judgments.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id"))).filter(F.col("rank") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain * _log2_gain(F.col("rank"))).alias("ideal"))
    dcg = lists.filter(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain * _log2_gain(F.col("rank"))).alias("dcg"))
    both = ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("judged_ndcg"))
    return _kept(queries, both, {"judged_ndcg": 0.0})


def coverage(queries: DataFrame, lists: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Judged part of the first k hits; 0 for an empty list."""
    j = judgments.select("query_id", "doc_id").distinct().withColumn("_j", F.lit(1.0))
    got = lists.filter(F.col("rank") <= k).join(j, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_j", F.lit(0.0))).alias("judged_coverage"))
    return _kept(queries, got, {"judged_coverage": 0.0})


def overlap(queries: DataFrame, lists: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Recall (hits over the truth's first k) and Jaccard of the first k. Empty truth: recall 0; both empty: Jaccard 1."""
    a, b = lists.filter(F.col("rank") <= k), truth.filter(F.col("rank") <= k)
    both = a.select("query_id", "doc_id", F.lit(1).alias("a")).join(b.select("query_id", "doc_id", F.lit(1).alias("b")), ["query_id", "doc_id"], "full")
    sums = both.groupBy("query_id").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0))).alias("nab"))
    got = sums.select("query_id", F.when(F.col("nb") > 0, F.col("nab") / F.col("nb")).otherwise(F.lit(0.0)).alias("recall"), (F.col("nab") / (F.col("na") + F.col("nb") - F.col("nab"))).alias("jaccard"))
    return _kept(queries, got, {"recall": 0.0, "jaccard": 1.0})


def kendall(queries: DataFrame, lists: DataFrame, truth: DataFrame) -> DataFrame:
    """Concordant less discordant pairs over all pairs of shared documents, against the whole truth list; fewer than two give 0.

    Pairs are formed within one query's list of at most some dozens of hits.
    """
    s = _shared(lists, truth)
    pairs = s.alias("x").join(s.alias("y"), (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.rc") < F.col("y.rc")))
    got = pairs.groupBy(F.col("x.query_id").alias("query_id")).agg((F.sum(F.signum((F.col("y.ro") - F.col("x.ro")).cast("double"))) / F.count(F.lit(1))).alias("kendall_tau"))
    return _kept(queries, got, {"kendall_tau": 0.0})


def rbo(queries: DataFrame, lists: DataFrame, truth: DataFrame, k: int = 10, p: float = 0.9) -> DataFrame:
    """Rank-biased overlap of both lists cut to k, normalised to the depth reached; two empty lists give 1.

    A shared document counts at every depth from the deeper of its two ranks on, so the sum over depths becomes a
    sum over shared documents.
    """
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    a, b = lists.filter(F.col("rank") <= k), truth.filter(F.col("rank") <= k)
    lengths = a.select("query_id", "rank").unionByName(b.select("query_id", "rank")).groupBy("query_id").agg(F.max("rank").alias("depth"))
    term = F.aggregate(F.sequence(F.greatest("rc", "ro").cast("int"), F.col("depth").cast("int")), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d.cast("double") - 1) / d.cast("double"))
    sums = _shared(a, b).join(lengths, "query_id").groupBy("query_id").agg(F.sum(term).alias("_s"))
    got = lengths.join(sums, "query_id", "left").select("query_id", (F.lit(1 - p) * F.coalesce("_s", F.lit(0.0)) / (F.lit(1.0) - F.pow(F.lit(p), F.col("depth").cast("double")))).alias("rbo"))
    return _kept(queries, got, {"rbo": 1.0})


def stripe_mix(lists: DataFrame) -> DataFrame:
    """(query_id, stripe_mix): hits per stripe as a map, and as text in the order of the names."""
    counts = lists.groupBy("query_id", "stripe").agg(F.count(F.lit(1)).cast("int").alias("n"))
    m = counts.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stripe", "n")))).alias("contribution"))
    return m.withColumn("stripe_mix", mix_text(F.col("contribution")))


def mix_text(contribution: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(contribution)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " | ")


def identical(queries: DataFrame, lists: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Whether the first k of both lists are the same documents in the same order."""
    a, b = lists.filter(F.col("rank") <= k), truth.filter(F.col("rank") <= k)
    both = a.select("query_id", "rank", F.col("doc_id").alias("da")).join(b.select("query_id", "rank", F.col("doc_id").alias("db")), ["query_id", "rank"], "full")
    got = both.groupBy("query_id").agg(F.min((F.coalesce(F.col("da") == F.col("db"), F.lit(False))).cast("int")).alias("same"))
    return _kept(queries, got, {"same": 1})


def all_metrics(queries: DataFrame, lists: DataFrame, truth: DataFrame, judgments: DataFrame | None = None, k: int = 10) -> DataFrame:
    out = ndcg(queries, lists, truth, k)
    for part in (overlap(queries, lists, truth, k), kendall(queries, lists.filter(F.col("rank") <= k), truth), rbo(queries, lists, truth, k)):
        out = out.join(part, "query_id")
    if judgments is not None:
        out = out.join(judged_ndcg(queries, lists, judgments, k), "query_id").join(coverage(queries, lists, judgments, k), "query_id")
    return out
