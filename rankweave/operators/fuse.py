"""Fusion strategies: pure functions from candidates to fused lists, with ``explain`` also how each score came about.

Candidates have query_id, mode, stripe, stripe_pos, doc_id, hit_rank, score, text_score, vector_similarity and
reranker_score. A fused list has query_id, mode, doc_id, stripe, fused_score and fused_rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import bm25, idf
from .ranks import hot_keys, parted, ranked_by_range, same

LIST = ["query_id", "mode"]
# The texts in which strategies explain a hit.
TEXTS = {
    "naive-score": "@search.score=%.4f from %s",
    "interleave": "rank %d in %s",
    "global-rrf": "1/(%d+%d) = %.6f from %s",
    "quota-merge": "quota %d (%d%% of corpus), rank %d in %s",
    "minmax-norm": "(%.4f-%.4f)/(%.4f-%.4f) = %.4f in %s",
    "zscore-norm": "z=(%.4f-%.4f)/%.4f = %.4f in %s",
    "vector-similarity": "cosine=%.4f from %s",
    "hybrid-legs": "%s = %.6f from %s",
    "idf-correct": "%.4f x %.3f = %.4f (%s IDF correction)",
    "bm25": "%s BM25 %.4f over %d/%d query terms (was %.4f in %s)",
    "semantic-score": "reranker=%.3f (0-4), from %s",
    "external-rerank": "external grade %d/3 (from %s)",
    "ungraded": "ungraded (from %s)",
}
#: Hits of one query from which on its ranks are made by ranges of the score.
HOT_ROWS = 200_000


def clean(raw: DataFrame) -> DataFrame:
    """Delivered hits as candidates: each (query, mode, stripe, document) once, the better rank first; scores that are no numbers become null, hits without a score are dropped."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    keys = [*LIST, "stripe", "stripe_pos", "doc_id"]
    one = raw.select(*keys, "hit_rank", *[number(c) for c in ("score", "text_score", "vector_similarity", "reranker_score")]).groupBy(*keys)
    return one.agg(F.min("hit_rank").alias("hit_rank"), *[F.max(c).alias(c) for c in ("score", "text_score", "vector_similarity", "reranker_score")]).filter("score is not null")


def rank_and_truncate(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Common tail: a document counts once with its best score, the earlier stripe first; best ``k`` by score, then id.

    Scores are compared at ``digits`` decimals, so that sums in another order cannot change a list.
    The first window is spread over (query, document), and the second cuts each map output to ``k`` rows a list
    before the shuffle, so a query with a large part of all hits is no bottleneck. An ``explanation`` is kept.
    """
    more = [x for x in ("explanation",) if x in scored.columns]
    fused = scored.filter("fused_score is not null").withColumn("fused_score", F.round("fused_score", digits))
    one = Window.partitionBy(*LIST, "doc_id").orderBy(F.col("fused_score").desc(), "stripe_pos", "hit_rank")
    order = Window.partitionBy(*LIST).orderBy(F.col("fused_score").desc(), "doc_id")
    best = fused.withColumn("_o", F.row_number().over(one)).filter("_o = 1")
    return best.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= k).select(*LIST, "doc_id", "stripe", "fused_score", "fused_rank", *more)


def told(scored: DataFrame, explain: bool, pattern: str, *columns: Column | str) -> DataFrame:
    """With ``explain`` add how the hit came to its score; ``fused_score`` stands rounded as lists are.

    Other figures are rounded at twelve decimals before they are printed with fewer, so that a mean halfway between
    two printed figures is the same text in whatever order it was added up.
    """
    if not explain:
        return scored
    given = [F.round(c, 9) if isinstance(c, str) and c == "fused_score" else F.col(c) if isinstance(c, str) else c for c in columns]
    kinds = [f.dataType for f in scored.select(*given).schema]
    steady = [F.round(c, 12) if isinstance(t, DoubleType) else c for c, t in zip(given, kinds)]
    return scored.withColumn("explanation", F.format_string(pattern, *steady))


def naive(c: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Raw scores."""
    return rank_and_truncate(told(c.withColumn("fused_score", F.col("score")), explain, TEXTS["naive-score"], "score", "stripe"), k, 12)


def interleave(c: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """By place in the list, then by stripe: -(place + stripe / stripes), places from 0.

    Stripes are numbered from 0 among those that answered the list, so the second term never reaches the next place.
    """
    answered = c.select(*LIST, "stripe_pos").distinct()
    order = F.row_number().over(Window.partitionBy(*LIST).orderBy("stripe_pos")) - 1
    numbered = answered.withColumn("_s", order).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*LIST)))
    scored = _beside(c, numbered, [*LIST, "stripe_pos"]).withColumn("fused_score", -(F.col("hit_rank") - 1 + F.col("_s") / F.col("_n")))
    return rank_and_truncate(told(scored, explain, TEXTS["interleave"], "hit_rank", "stripe"), k)


def rrf(c: DataFrame, k: int = 10, constant: int = 60, explain: bool = False) -> DataFrame:
    """1 / (constant + rank); a document in several stripes keeps the larger."""
    scored = c.withColumn("fused_score", F.lit(1.0) / (F.lit(float(constant)) + F.col("hit_rank")))
    return rank_and_truncate(told(scored, explain, TEXTS["global-rrf"], F.lit(constant), "hit_rank", "fused_score", "stripe"), k)


def rrf_sum(c: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal ranks of a document summed over the stripes."""
    first = F.min_by("stripe", F.struct("stripe_pos", "hit_rank")).alias("stripe")
    s = c.groupBy(*LIST, "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("hit_rank"))).alias("fused_score"), first, F.min("stripe_pos").alias("stripe_pos"), F.min("hit_rank").alias("hit_rank"))
    return rank_and_truncate(s, k)


def _beside(c: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate with the figures of its group, where there are some; null keys are groups too."""
    figures = [F.col(f"o.{x}").alias(x) for x in other.columns if x not in keys]
    return c.alias("c").join(other.alias("o"), same("c", "o", keys)).select("c.*", *figures)


def quota(c: DataFrame, sizes: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Each answering stripe gives its share of ``k`` by size (half to even, one at least), ordered by rank; no sizes, no list."""
    returned = c.select(*LIST, "stripe").distinct().join(sizes.select("stripe", "n_docs"), "stripe", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    total = F.sum("n_docs").over(Window.partitionBy(*LIST))
    part = F.col("n_docs") / F.col("_all")
    shares = returned.withColumn("_all", total).filter("_all > 0").select(*LIST, "stripe", F.greatest(F.lit(1), F.bround(F.lit(float(k)) * part)).cast("int").alias("_quota"), F.round(part * 100).cast("int").alias("_percent"))
    scored = _beside(c, shares, [*LIST, "stripe"]).filter("hit_rank <= _quota").withColumn("fused_score", -F.col("hit_rank").cast("double"))
    return rank_and_truncate(told(scored, explain, TEXTS["quota-merge"], "_quota", "_percent", "hit_rank", "stripe"), k)


def minmax(c: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Scores of a stripe stretched to 0..1; without a range all are 1."""
    s = c.groupBy(*LIST, "stripe").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    score = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
    scored = _beside(c, s, [*LIST, "stripe"]).withColumn("fused_score", score)
    return rank_and_truncate(told(scored, explain, TEXTS["minmax-norm"], "score", "_lo", "_hi", "_lo", "fused_score", "stripe"), k)


def zscore(c: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Scores of a stripe in population standard deviations from their mean; without a spread all are 0."""
    s = c.groupBy(*LIST, "stripe").agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"), F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    score = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    scored = _beside(c, s, [*LIST, "stripe"]).withColumn("fused_score", score)
    return rank_and_truncate(told(scored, explain, TEXTS["zscore-norm"], "score", "_m", "_s", "fused_score", "stripe"), k)


def by_vector(c: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Vector similarity, or the score itself in vector mode; others are dropped."""
    scored = c.withColumn("fused_score", F.coalesce("vector_similarity", F.when(F.col("mode") == "Vector", F.col("score"))))
    return rank_and_truncate(told(scored, explain, TEXTS["vector-similarity"], "fused_score", "stripe"), k)


def legs(c: DataFrame, k: int = 10, constant: int = 60, hot_rows: int = HOT_ROWS, delivered: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """Both legs ranked anew over all stripes, reciprocal ranks summed; hits of no leg are dropped.

    Queries over ``hot_rows`` hits are ranked by ranges of (list, score) instead of in one task; the ranks are the
    same. ``delivered`` is a table in which the hits of a query can be counted where ``c`` is costly to make; it may
    count too many.
    """
    hot = hot_keys((c if delivered is None else delivered).select("query_id"), "query_id", hot_rows)
    usual, big = parted(c, hot, "query_id")
    share = lambda rank: F.lit(1.0) / (F.lit(float(constant)) + F.col(rank))
    ties = [F.col("doc_id"), F.col("stripe_pos"), F.col("stripe")]
    placed = lambda name: F.when(F.col(name).isNotNull(), F.row_number().over(Window.partitionBy(*LIST).orderBy(F.col(name).desc_nulls_last(), *ties)).cast("long"))
    parts = usual.withColumn("_t", placed("text_score")).withColumn("_v", placed("vector_similarity"))
    if big is not None:
        for name, out in (("text_score", "_t"), ("vector_similarity", "_v")):
            ranked = ranked_by_range(big.filter(F.col(name).isNotNull()), LIST, name, "_r", ties)
            big = ranked.withColumn(out, F.col("_r").cast("long")).drop("_r").unionByName(big.filter(F.col(name).isNull()).withColumn(out, F.lit(None).cast("long")))
        parts = parts.unionByName(big)
    both = F.when(F.col("_t").isNotNull() | F.col("_v").isNotNull(), F.coalesce(share("_t"), F.lit(0.0)) + F.coalesce(share("_v"), F.lit(0.0)))
    found = F.concat_ws(" + ", F.concat(F.lit("text#"), F.col("_t").cast("string")), F.concat(F.lit("vector#"), F.col("_v").cast("string")))
    return rank_and_truncate(told(parts.withColumn("fused_score", both), explain, TEXTS["hybrid-legs"], found, "fused_score", "stripe"), k)


def correction(qterms: DataFrame, df_global: DataFrame, n_global: DataFrame, df_local: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, stripe, factor): by how much a stripe's own term weights distort its scores, weighted by the global ones.

    Terms that a stripe lacks, or whose weight there is not above 0, do not count.
    """
    g = idf(F.col("df_g"), F.col("n_g"))
    local = idf(F.col("df"), F.col("n_docs"))
    t = qterms.join(df_global.select("term", F.col("df").alias("df_g")), "term").withColumn("n_g", n_global.select("n_docs").scalar()).join(df_local.select("stripe", "term", "df"), "term").join(F.broadcast(sizes.select("stripe", "n_docs")), "stripe")
    t = t.filter("df > 0 and n_docs > 0").select("query_id", "stripe", g.alias("g"), local.alias("l")).filter("l > 0")
    return t.groupBy("query_id", "stripe").agg((F.sum(F.col("g") / F.col("l") * F.col("g")) / F.sum("g")).alias("factor"))


def idf_corrected(c: DataFrame, factors: DataFrame, k: int = 10, explain: bool = False) -> DataFrame:
    """Text score (else score) times the stripe's factor; without a factor, as for queries without terms, it stays."""
    base = F.coalesce("text_score", "score") * F.coalesce("factor", F.lit(1.0))
    own = factors.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("stripe", "factor"))).alias("_own"))
    joined = c.join(own, "query_id", "left").withColumn("factor", F.try_element_at("_own", F.col("stripe"))).withColumn("_has", F.col("_own").isNotNull())
    scored = joined.withColumn("fused_score", F.when(F.col("_has"), base).otherwise(F.col("score")))
    given = F.when(F.col("_has"), F.coalesce("text_score", "score")).otherwise(F.col("score"))
    return rank_and_truncate(told(scored, explain, TEXTS["idf-correct"], given, F.coalesce("factor", F.lit(1.0)), "fused_score", "stripe"), k)


def rescored(c: DataFrame, near: DataFrame, qterms: DataFrame, df: DataFrame, size: DataFrame, k: int = 10, local: bool = False, explain: bool = False) -> DataFrame:
    """BM25 recomputed from the postings with corpus-wide (or, as a control, the stripe's own) statistics.

    ``near`` (doc_id, stripe, doc_len, term, tf) is read for the candidates' own terms only. Candidates that hold no
    query term keep their place at 0; queries without terms keep the raw score.
    """
    keys = ["stripe", "term"] if local else ["term"]
    own = c.select("query_id", "doc_id").distinct().join(qterms, "query_id").join(near.select("doc_id", "stripe", "doc_len", "term", "tf"), ["doc_id", "term"]).join(df.select(*keys, "df"), keys)
    if local:
        own = own.join(F.broadcast(size), "stripe")
    else:
        own = own.withColumn("n_docs", size.select("n_docs").scalar()).withColumn("avgdl", size.select("avgdl").scalar())
    part = bm25(idf(F.col("df"), F.col("n_docs")), F.col("tf").cast("double"), F.col("doc_len"), F.col("avgdl"))
    sums = own.groupBy("query_id", "doc_id").agg(F.sum(part).alias("_b"), F.count(F.lit(1)).alias("_h"))
    asked = qterms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_q"))
    return _by_sums(c.join(sums, ["query_id", "doc_id"], "left").join(asked, "query_id", "left"), k, local, explain)


def rescored_in_search(c: DataFrame, k: int = 10, local: bool = False, explain: bool = False) -> DataFrame:
    """``rescored`` for the hits of a keyword search, which has added up both scores (``text_score`` with the stripe's own statistics, ``whole``) and counted the terms."""
    sums = F.col("text_score") if local else F.col("whole")
    return _by_sums(c.withColumn("_b", sums).withColumn("_h", F.col("held")).withColumn("_q", F.col("need")), k, local, explain)


def _by_sums(joined: DataFrame, k: int, local: bool, explain: bool) -> DataFrame:
    """Lists by recomputed scores: ``_b`` over ``_h`` of ``_q`` terms."""
    scored = joined.withColumn("fused_score", F.when(F.col("_q") > 0, F.coalesce("_b", F.lit(0.0))).otherwise(F.col("score")))
    figures = ["fused_score", F.coalesce("_h", F.lit(0)), F.coalesce("_q", F.lit(0)), F.coalesce("text_score", "score"), "stripe"]
    return rank_and_truncate(told(scored, explain, TEXTS["bm25"], F.lit("local" if local else "global"), *figures), k)


def yields(qterms: DataFrame, df_global: DataFrame, n_global: DataFrame, df_local: DataFrame) -> DataFrame:
    """(query_id, stripe, yield): the summed global weight of the query's terms over the stripe's documents."""
    t = qterms.join(df_global.select("term", F.col("df").alias("df_g")), "term").withColumn("n_g", n_global.select("n_docs").scalar()).join(df_local.select("stripe", "term", "df"), "term")
    return t.groupBy("query_id", "stripe").agg(F.round(F.sum(idf(F.col("df_g"), F.col("n_g")) * F.col("df")), 9).alias("yield"))


def selected(queries: DataFrame, stripes: list[str], per_stripe: DataFrame, threshold: float) -> DataFrame:
    """(query_id, stripe, chosen): the stripes a query is sent to, and how many those are.

    Stripes whose yield is at least ``threshold`` times the best one's; all of them where no yield is above 0.
    """
    grid = queries.select("query_id", F.explode(F.array(*[F.lit(s) for s in stripes])).alias("stripe"))
    y = grid.join(per_stripe, ["query_id", "stripe"], "left").withColumn("yield", F.coalesce("yield", F.lit(0.0)))
    best = y.groupBy("query_id").agg(F.max("yield").alias("_best"))
    kept = y.join(best, "query_id").filter((F.col("_best") <= 0) | (F.col("yield") >= F.col("_best") * threshold))
    n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("chosen"))
    return kept.join(n, "query_id").select("query_id", "stripe", "chosen")


def selective(c: DataFrame, chosen: DataFrame, near: DataFrame, qterms: DataFrame, df: DataFrame, size: DataFrame, k: int = 10, total: int = 50) -> DataFrame:
    """Only the chosen stripes answer, each with an equal part of ``total``. One stripe's list keeps its own order; several are rescored."""
    kept = c.join(chosen, ["query_id", "stripe"]).filter(F.col("hit_rank") <= F.ceil(F.lit(float(total)) / F.col("chosen")))
    own = Window.partitionBy(*LIST).orderBy(F.col("score").desc(), "hit_rank")
    one = kept.filter("chosen = 1").withColumn("fused_rank", F.row_number().over(own)).filter(F.col("fused_rank") <= k).select(*LIST, "doc_id", "stripe", F.col("score").alias("fused_score"), "fused_rank")
    return one.unionByName(rescored(kept.filter("chosen > 1").drop("chosen"), near, qterms, df, size, k))


def by_reranker(c: DataFrame, k: int = 10, strict: bool = False, explain: bool = False) -> DataFrame:
    """The second-stage score; hits without one are dropped.

    ``strict`` makes a run in which hits came but no hit of any list has such a score an error instead of an empty
    result; it is raised when the plan runs, not when it is made, and costs one count beside the plan.
    """
    scored = c.withColumn("fused_score", F.col("reranker_score"))
    sure = require_scores(scored) if strict else scored
    return rank_and_truncate(told(sure, explain, TEXTS["semantic-score"], "fused_score", "stripe"), k)


def require_scores(c: DataFrame) -> DataFrame:
    """The candidates, with an error raised on execution where there are some and none has a reranker score."""
    seen = c.agg(F.count(F.lit(1)).alias("n"), F.count("reranker_score").alias("m")).select((F.col("n") > 0) & (F.col("m") == 0)).scalar()
    text = "no candidate has a reranker score; run retrieval with the semantic stage"
    return c.filter(F.when(seen, F.raise_error(F.lit(text)).cast("boolean")).otherwise(F.lit(True)))


def reranked_again(c: DataFrame, scorer: DataFrame, k: int = 10, depth: int = 25) -> DataFrame:
    """The first ``depth`` of each stripe scored a second time by ``scorer`` (query_id, doc_id, rescore); unscored hits are dropped."""
    pool = c.filter(F.col("hit_rank") <= depth).join(scorer, ["query_id", "doc_id"])
    return rank_and_truncate(pool.withColumn("fused_score", F.col("rescore")), k)


def pool(c: DataFrame, size: int = 50) -> DataFrame:
    """The first ``size`` hits of a query, rank by rank across the stripes, each document once."""
    one = Window.partitionBy(*LIST, "doc_id").orderBy("hit_rank", "stripe_pos")
    order = Window.partitionBy(*LIST).orderBy("hit_rank", "stripe_pos", "doc_id")
    return c.withColumn("_o", F.row_number().over(one)).filter("_o = 1").drop("_o").withColumn("pool_rank", F.row_number().over(order)).filter(F.col("pool_rank") <= size)


def external(c: DataFrame, grades: DataFrame, k: int = 10, size: int = 50, explain: bool = False) -> DataFrame:
    """A pool graded 0 to 3 from outside (query_id, doc_id, grade); ungraded is 0. The score, cut to 0..1000, over 100,000 breaks ties."""
    p = pool(c, size).join(grades, ["query_id", "doc_id"], "left")
    tie = F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col("score"))) / F.lit(100000.0)
    scored = p.withColumn("fused_score", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)) + tie)
    if explain:
        graded = F.format_string(TEXTS["external-rerank"], "grade", "stripe")
        scored = scored.withColumn("explanation", F.when(F.col("grade") >= 0, graded).otherwise(F.format_string(TEXTS["ungraded"], "stripe")))
    return rank_and_truncate(scored, k)


def planned(rewrites: DataFrame, retrieved: DataFrame, k: int = 10) -> DataFrame:
    """Subqueries of each query (query_id, sub_id) answered apart (their candidates' query_id is the sub_id); a document keeps its best reranker score."""
    own = retrieved.withColumnRenamed("query_id", "sub_id").join(rewrites, "sub_id")
    return by_reranker(own, k)


def single_index(c: DataFrame, k: int = 10) -> DataFrame:
    """The un-split index in its own order: reranker score if there is one, else score; ties keep the rank."""
    score = F.coalesce("reranker_score", "score")
    order = Window.partitionBy(*LIST).orderBy(score.desc(), "hit_rank")
    return c.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= k).select(*LIST, "doc_id", "stripe", F.round(score, 9).alias("fused_score"), "fused_rank")
