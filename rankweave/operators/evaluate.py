"""Summaries, cost and accounting of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles, same

# Published prices in dollars, and the published fit of compute units to indexes and results.
PER_CU_HOUR, PER_1K_SEMANTIC, PER_1M_AGENTIC, PER_1M_MODEL = 0.27, 1.00, 0.022, 0.40
CU_PER_INDEX, CU_PER_RESULT = 0.00017, 0.0000054


def once(records: DataFrame) -> DataFrame:
    """Each record once, the last delivery of it; latencies that were not measured are null."""
    cols = [c for c in records.columns if c not in ("record_id", "ingested_at")]
    last = records.filter("record_id is not null").groupBy("record_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("r")).select("record_id", "r.*")
    return last.withColumn("latency_ms", F.when((F.col("latency_ms") > 0) & ~F.isnan("latency_ms"), F.col("latency_ms")))


def strategy_summary(records: DataFrame, keys: list[str] = ["mode", "strategy"]) -> DataFrame:
    """Means, with null where nothing was measured, and exact nearest-rank percentiles of the latency."""
    means = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("judged_ndcg").alias("judged_ndcg"),
        F.avg("compute_units").alias("compute_units"),
        F.avg("agentic_tokens").alias("agentic_tokens"),
    )
    p = percentiles(records, keys, "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    return means.alias("m").join(p.alias("p"), same("m", "p", keys), "left").select("m.*", "p.latency_p50_ms", "p.latency_p95_ms")


def span_breakdown(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Fidelity by span of the query, 0 where there is none, and the difference; ``spans`` is (query_id, span)."""
    joined = records.join(spans, "query_id")
    mean = lambda s: F.coalesce(F.avg(F.when(F.col("span") == s, F.col("ndcg"))), F.lit(0.0))
    got = joined.groupBy("mode", "strategy").agg(mean("StripeLocal").alias("local_ndcg"), mean("CrossStripe").alias("cross_ndcg"))
    return got.withColumn("delta", F.col("cross_ndcg") - F.col("local_ndcg"))


def compute_model(indexes: Column, results: Column) -> Column:
    return F.lit(CU_PER_INDEX) * indexes + F.lit(CU_PER_RESULT) * results


def metered(semantic: Column, agentic: Column, model: Column) -> Column:
    """Dollars per thousand queries for ranker calls and tokens."""
    return semantic * F.lit(PER_1K_SEMANTIC) + agentic * F.lit(0.001 * PER_1M_AGENTIC) + model * F.lit(0.001 * PER_1M_MODEL)


def cost_tradeoff(summary: DataFrame, baseline: str, requests: DataFrame | None = None) -> DataFrame:
    """Quality, cost and capacity of each strategy against the baseline of its mode.

    ``requests`` (strategy, ranker_calls) says how often the ranker runs for a query. Modes without the baseline
    give nothing. Unseen compute (0 or null) has no capacity figure.
    """
    base = summary.filter(F.col("strategy") == baseline).select("mode", F.coalesce("judged_ndcg", F.lit(0.0)).alias("_q"), F.col("compute_units").alias("_c"))
    calls = summary.join(requests, "strategy", "left") if requests is not None else summary.withColumn("ranker_calls", F.lit(0))
    j = calls.join(base, "mode").withColumn("calls", F.bround(F.coalesce("ranker_calls", F.lit(0)).cast("double")))
    agentic = F.bround(F.coalesce("agentic_tokens", F.lit(0.0)))
    m = metered(F.col("calls"), agentic, F.lit(0.0))
    quality = F.coalesce("judged_ndcg", F.lit(0.0))
    multiple = F.when((F.col("compute_units") > 0) & (F.col("_c") > 0), F.col("compute_units") / F.col("_c"))
    return j.select(
        "mode",
        "strategy",
        quality.alias("quality"),
        F.when(F.col("_q") > 0, quality / F.col("_q")).alias("vs_single"),
        m.alias("metered_per_1k"),
        (m + F.coalesce("compute_units", F.lit(0.0)) * F.lit(PER_CU_HOUR * 1000)).alias("serverless_per_1k"),
        multiple.alias("capacity"),
        (F.lit(1.0) / multiple).alias("peak_qps"),
        "latency_p50_ms",
    )


def accounting(requests: DataFrame, strategies: DataFrame) -> DataFrame:
    """Requests, compute and latency charged to each strategy of a query.

    ``requests``: (query_id, strategy or null for the shared fan-out, requests, compute_units, elapsed_ms).
    ``strategies``: (strategy, own_retrieval). Shared work is charged to all that use it, not to those that did
    their own; latency of the shared fan-out is its slowest request, its compute the sum.
    """
    shared = requests.filter("strategy is null").groupBy("query_id").agg(F.sum("requests").alias("sr"), F.sum("compute_units").alias("sc"), F.max("elapsed_ms").alias("sl"))
    own = requests.filter("strategy is not null").groupBy("query_id", "strategy").agg(F.sum("requests").alias("r"), F.sum("compute_units").alias("c"), F.max("elapsed_ms").alias("l"))
    names = [(r["strategy"], r["own_retrieval"]) for r in strategies.select("strategy", "own_retrieval").collect()]
    cross = shared.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(bool(o)).alias("own_retrieval")) for n, o in names])))
    j = cross.join(own, ["query_id", "strategy"], "left")
    both = lambda a, b: F.coalesce(F.col(b), F.lit(0)) + F.when(F.col("own_retrieval"), F.lit(0)).otherwise(F.col(a))
    return j.select("query_id", "strategy", both("sr", "r").alias("queries"), both("sc", "c").alias("compute_units"), both("sl", "l").alias("latency_ms"))


def first_probes(requests: DataFrame) -> DataFrame:
    """Probes that were really sent: the first of each (stripe, term) in the order of the queries; later ones came from the cache."""
    w = Window.partitionBy("stripe", "term").orderBy("query_no")
    return requests.withColumn("_o", F.row_number().over(w)).filter("_o = 1").drop("_o")


def apply_judgments(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Judged figures joined by query; a query without judgments has null, not 0."""
    return records.drop("judged_ndcg", "judged_coverage").join(scores, [c for c in ("query_id", "mode", "strategy") if c in scores.columns], "left")


def judgment_pool(*lists: DataFrame) -> DataFrame:
    """Every (query_id, doc_id) that any list returned."""
    out = lists[0].select("query_id", "doc_id")
    for x in lists[1:]:
        out = out.unionByName(x.select("query_id", "doc_id"))
    return out.distinct()
