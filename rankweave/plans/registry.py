"""Queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, routing, statistics, text
from ..functions import vectors as vec
from ..operators import corpus_stats, evaluate, fuse, metrics, prep, retrieve, significance
from ..session import cut_by, durable, durable_by
from ..sources import tables
from ..sources.tables import read_table
from ..spec import Split
from . import files, matrix
from .catalog import STRATEGIES
from .inputs import DEPTH, GENRE_TAGS, SPEC, STRIPES, TOP, Retrieved, corpus, halves, hits, index_of, number_of, retrieved, stored_sizes, vector_queries, vectors, whole_of

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _add(name: str, f: Query) -> None:
    _QUERIES[name] = f


def searched(f: Callable[[Retrieved], DataFrame], name: str = "") -> Callable[[Retrieved], DataFrame]:
    """Register a search twice: over the stated query set, and as ``eval_...`` over every query of ``eval_queries``."""
    name = name or f.__name__
    _add(name, lambda spark, d: f(retrieved(spark, d)))
    _add(f"eval_{name}", lambda spark, d: f(retrieved(spark, d, True)))
    return f


def _six(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _fused(df: DataFrame, digits: int = 9) -> DataFrame:
    return _six(df.select("query_id", "mode", "doc_id", "stripe", "fused_score", "fused_rank"), digits)


# --- routing and fields -------------------------------------------------------------------------------------------


@query
def route_category(spark, d):
    return corpus(spark, d).select("doc_id", "stripe")


@query
def route_temporal(spark, d):
    return prep.catalog(read_table(spark, d, "books")).select("book_id", routing.by_year("publication_year", 1980, "book_id").alias("stripe"))


@query
def route_hash(spark, d):
    return read_table(spark, d, "documents").select("doc_id", routing.by_hash("doc_id").alias("stripe"))


@query
def split_catalog(spark, d):
    """Every way to divide the corpus by its name, which goes into paths and statistics, with the sizes of its stripes."""
    docs = corpus(spark, d)
    kinds = {Split("category"): F.col("stripe"), Split("hash"): routing.by_hash("doc_id"), Split("hash", seed=7): routing.by_hash("doc_id", 7), Split("temporal", cut=500): routing.by_year(F.col("doc_id").cast("int"), 500, "doc_id")}
    names = F.inline(F.array(*[F.struct(F.lit(k.name).alias("split"), c.alias("part")) for k, c in kinds.items()]))
    return docs.select(names).groupBy("split", "part").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def oracle_fanout(spark, d):
    return routing.with_oracle(corpus(spark, d).select("doc_id", "stripe")).groupBy("arm", "index_name", "stripe").agg(F.count(F.lit(1)).alias("n"))


@query
def tokenize(spark, d):
    toks = text.tokenize("text")
    return read_table(spark, d, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


@query
def query_terms(spark, d):
    q = read_table(spark, d, "eval_queries").select("query_id", "text").filter("query_id is not null").distinct()
    return q.select("query_id", F.array_join(text.query_terms("text"), " ").alias("terms")).distinct()


@query
def idf(spark, d):
    i = index_of(spark, d)
    return i.df_global.select("term", "df", F.round(text.idf(F.col("df"), i.size.select("n_docs").scalar()), 6).alias("idf"))


@query
def normalize_language(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.normalize_language("lang").alias("language"))


@query
def parse_numeric(spark, d):
    b = read_table(spark, d, "books").select("book_id", text.parse_year("original_publication_year").alias("year"), text.parse_rating("average_rating").alias("rating"))
    return b.groupBy("book_id", "year", "rating").agg(F.count(F.lit(1)).alias("n"))


@query
def split_authors(spark, d):
    b = read_table(spark, d, "books").select("book_id", F.array_join(text.split_authors("authors"), "|").alias("authors"))
    return b.distinct()


@query
def catalog_rows(spark, d):
    c = prep.catalog(read_table(spark, d, "books"))
    return c.select("book_id", "publication_year", "language", "genre", F.size("authors").alias("n_authors"))


@query
def parse_grade(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.parse_grade("text").alias("grade"))


@query
def split_custom_id(spark, d):
    c = read_table(spark, d, "candidates").select(F.concat_ws("~", "query_id", F.col("doc_id").cast("string")).alias("custom_id")).distinct()
    q, doc = text.split_custom_id("custom_id")
    return c.select(q.alias("query_id"), doc.alias("doc"))


@query
def embedding_input(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(text.embedding_input(F.col("title"), F.array("source"), F.col("text")), 256).alias("digest"))


@query
def json_fields(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.device").alias("device")).agg(F.count(F.lit(1)).alias("n"))


@query
def vector_quantize(spark, d):
    p = vec.quantize(F.col("embedding"))
    return _six(vectors(spark, d).select("doc_id", p["scale"].alias("scale"), F.array_join(F.transform(p["q"], lambda x: x.cast("string")), ",").alias("q")))


@query
def vector_dequantize(spark, d):
    back = vec.dequantize(vec.quantize(F.col("embedding")))
    gap = F.array_max(F.zip_with(back, "embedding", lambda x, y: F.abs(x - y.cast("double"))))
    return _six(vectors(spark, d).select("doc_id", gap.alias("largest_error"), vec.cosine(back, F.col("embedding")).alias("cosine")))


# --- corpus statistics --------------------------------------------------------------------------------------------


def _tokens(spark, d):
    return corpus_stats.tokenized(corpus(spark, d), SPEC)


@query
def df_local(spark, d):
    return corpus_stats.df_local(_tokens(spark, d))


@query
def df_global(spark, d):
    return corpus_stats.df_global(corpus_stats.df_local(_tokens(spark, d)))


@query
def df_rollup(spark, d):
    return corpus_stats.df_rollup(_tokens(spark, d))


@query
def stripe_stats(spark, d):
    return _six(corpus_stats.sizes(_tokens(spark, d)))


@query
def idf_divergence(spark, d):
    return _six(corpus_stats.idf_divergence(_tokens(spark, d), "a", "b"))


@query
def size_imbalance(spark, d):
    return _six(corpus_stats.imbalance(_tokens(spark, d)))


@query
def idf_band_decay(spark, d):
    return _six(corpus_stats.band_decay(_tokens(spark, d), "a", "b"))


# --- retrieval ----------------------------------------------------------------------------------------------------


def _hit(df: DataFrame, *more: str) -> DataFrame:
    return _six(df.select("query_id", "stripe", "doc_id", "hit_rank", "score", *more), 9)


@searched
def keyword_topk(r: Retrieved) -> DataFrame:
    return _hit(r.per_index)


@searched
def oracle_topk(r: Retrieved) -> DataFrame:
    return _hit(r.oracle)


@searched
def filtered_retrieval(r: Retrieved) -> DataFrame:
    """Documents in English only; the filter is applied before the best are taken, statistics are those of all."""
    return _hit(r.keyword(TOP, corpus(r.spark, r.d).filter(F.col("language") == "en").select("doc_id")))


@query
def vector_topk(spark, d):
    return _hit(retrieve.vector(vectors(spark, d), vector_queries(spark, d), 50, STRIPES))


def _hybrid_parts(spark, d):
    """Text leg: the documents' titles of the vector queries; vector leg: their vectors, in the stripe of the document."""
    asked = vector_queries(spark, d)
    names = read_table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")).join(asked.select("query_id"), "query_id", "left_semi")
    r = Retrieved(spark, d, names)
    own = vectors(spark, d).drop("stripe").join(r.index.lengths.select("doc_id", "stripe"), "doc_id")
    return r.keyword(DEPTH), retrieve.vector(own, asked, DEPTH, STRIPES)


@query
def hybrid_topk(spark, d):
    t, v = _hybrid_parts(spark, d)
    return _hit(retrieve.hybrid(t, v, 50, STRIPES), "text_score", "vector_similarity")


@searched
def semantic_scores(r: Retrieved) -> DataFrame:
    return _hit(r.candidates, "reranker_score")


@searched
def fan_out(r: Retrieved) -> DataFrame:
    """Hits per stripe; each stripe answers by itself, and one that fails costs its own hits only."""
    counted = lambda s: r.candidates.filter(F.col("stripe") == s).groupBy("query_id", "stripe").agg(F.count(F.lit(1)).alias("returned"))
    return retrieve.answered({s: lambda s=s: counted(s) for s in STRIPES})[0]


@searched
def candidate_budget(r: Retrieved) -> DataFrame:
    sides = [(r.candidates, "equalized"), (r.per_index, "per-index")]
    parts = [x.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned")).withColumn("budget", F.lit(n)) for x, n in sides]
    return parts[0].unionByName(parts[1])


@searched
def df_probe(r: Retrieved) -> DataFrame:
    return r.df_local


@query
def doc_counts(spark, d):
    return retrieve.counts(corpus(spark, d))


# --- fusion -------------------------------------------------------------------------------------------------------

for _name, _plan in {"interleave": fuse.interleave, "global_rrf": fuse.rrf, "rrf_sum": fuse.rrf_sum, "minmax_norm": fuse.minmax, "vector_similarity": fuse.by_vector, "semantic_score": lambda c, k: fuse.by_reranker(c, k, strict=True)}.items():
    _add(_name, lambda spark, d, plan=_plan: _fused(plan(hits(spark, d), TOP)))


@query
def naive_score(spark, d):
    return _fused(fuse.naive(hits(spark, d), TOP), 12)


@query
def zscore_norm(spark, d):
    return _fused(fuse.zscore(hits(spark, d), TOP))


@query
def hybrid_legs(spark, d):
    hybrid = F.col("mode") == "Hybrid"
    return _fused(fuse.legs(hits(spark, d).filter(hybrid), TOP, delivered=read_table(spark, d, "candidates").filter(hybrid)))


@query
def hybrid_legs_by_range(spark, d):
    """The same with every query over 50 hits ranked by ranges, the way that hot queries go."""
    hybrid = F.col("mode") == "Hybrid"
    return _fused(fuse.legs(hits(spark, d).filter(hybrid), TOP, hot_rows=50))


@query
def quota_merge(spark, d):
    return _fused(fuse.quota(hits(spark, d), stored_sizes(spark, d), TOP))


@query
def select_pool(spark, d):
    return fuse.pool(hits(spark, d), 50).select("query_id", "mode", "doc_id", "stripe", "pool_rank")


def _explained(plans: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, p in plans.items():
        one = p.select("query_id", "mode", F.lit(name).alias("strategy"), "doc_id", "stripe", "fused_rank", "explanation")
        out = one if out is None else out.unionByName(one)
    return out


@query
def explain_fusion(spark, d):
    """The first ten of each delivered list by nine strategies, with how each score came about."""
    h = durable(hits(spark, d))
    plans = {"naive-score": fuse.naive, "interleave": fuse.interleave, "global-rrf": fuse.rrf, "minmax-norm": fuse.minmax, "zscore-norm": fuse.zscore, "vector-similarity": fuse.by_vector, "semantic-score": fuse.by_reranker}
    lists = {n: f(h, TOP, explain=True) for n, f in plans.items()}
    lists["quota-merge"] = fuse.quota(h, stored_sizes(spark, d), TOP, explain=True)
    lists["hybrid-legs"] = fuse.legs(h.filter(F.col("mode") == "Hybrid"), TOP, explain=True)
    return _explained(lists)


@searched
def explain_search(r: Retrieved) -> DataFrame:
    """The same for the strategies that know the query's terms or a grade."""
    c = r.candidates
    return _explained({
        "idf-correct-probe": fuse.idf_corrected(c, _factors(r), TOP, explain=True),
        "global-bm25": fuse.rescored_in_search(c, TOP, explain=True),
        "local-bm25": fuse.rescored_in_search(c, TOP, local=True, explain=True),
        "external-rerank": fuse.external(c, _grades(r).filter("doc_id % 3 > 0"), TOP, explain=True),
    })


def _grades(r: Retrieved) -> DataFrame:
    """Grades of a stand-in for an external grader."""
    return r.candidates.select("query_id", "doc_id", F.floor(F.col("reranker_score") * 0.75).cast("int").alias("grade"))


def _factors(r: Retrieved) -> DataFrame:
    return fuse.correction(r.qterms, r.df_global, r.size, r.df_local, r.sizes)


@searched
def idf_factors(r: Retrieved) -> DataFrame:
    return _six(_factors(r))


@searched
def idf_correct_sidecar(r: Retrieved) -> DataFrame:
    """With the frequencies of the stored statistics."""
    i = r.index
    return _fused(fuse.idf_corrected(r.candidates, fuse.correction(r.qterms, i.df_global, i.size, i.df_local, i.sizes), TOP))


@searched
def idf_correct_probe(r: Retrieved) -> DataFrame:
    return _fused(fuse.idf_corrected(r.candidates, _factors(r), TOP))


@searched
def global_bm25(r: Retrieved) -> DataFrame:
    return _fused(fuse.rescored_in_search(r.candidates, TOP))


@searched
def local_bm25(r: Retrieved) -> DataFrame:
    return _fused(fuse.rescored_in_search(r.candidates, TOP, local=True))


@searched
def merge_naive(r: Retrieved) -> DataFrame:
    return _fused(fuse.naive(r.candidates, TOP), 12)


@searched
def merge_bm25(r: Retrieved) -> DataFrame:
    """Corpus-wide BM25 with the plain tokenizer, which keeps stop words."""
    p = Retrieved(r.spark, r.d, r.queries, stop=False)
    return _fused(fuse.rescored_in_search(p.keyword(25), TOP))


@searched
def merge_idf(r: Retrieved) -> DataFrame:
    return _fused(fuse.idf_corrected(r.per_index, _factors(r), TOP))


@query
def merge_vector(spark, d):
    return _fused(fuse.by_vector(retrieve.vector(vectors(spark, d), vector_queries(spark, d), 25, STRIPES), TOP))


def _selective(threshold: float) -> Callable[[Retrieved], DataFrame]:
    def run(r: Retrieved) -> DataFrame:
        return _fused(fuse.selective(r.per_index, r.chosen(threshold), r.matched, r.qterms, r.df_global, r.size, TOP))

    return run


searched(_selective(1.0), "selective_one")
searched(_selective(0.35), "selective_adaptive")


def _rescores(r: Retrieved) -> DataFrame:
    """A second opinion on each hit, from its stripe-independent score."""
    return r.per_index.select("query_id", "doc_id", (F.col("reranker_score") + F.lit(0.01) * F.log(F.lit(1.0) + F.col("doc_len"))).alias("rescore"))


@searched
def semantic_merge(r: Retrieved) -> DataFrame:
    return _fused(fuse.by_reranker(r.candidates, TOP, strict=True))


@searched
def semantic_rerank(r: Retrieved) -> DataFrame:
    return _fused(fuse.reranked_again(r.candidates, _rescores(r), TOP))


@searched
def rerank_existing(r: Retrieved) -> DataFrame:
    """A result that was retrieved without the second stage, scored in another query of each stripe, 50 keys at most."""
    return _fused(fuse.reranked_again(r.keyword(DEPTH), _rescores(r), TOP, depth=50))


@searched
def external_rerank(r: Retrieved) -> DataFrame:
    return _fused(fuse.external(r.candidates, _grades(r), TOP))


@searched
def agentic_rerank(r: Retrieved) -> DataFrame:
    return _fused(fuse.by_reranker(r.per_index, 50))


@searched
def agentic_cheap(r: Retrieved) -> DataFrame:
    return _fused(fuse.interleave(r.per_index, 50))


@searched
def agentic_planned(r: Retrieved) -> DataFrame:
    """Subqueries by the stand-in planner; a query of one term or none is its own single subquery."""
    plan = durable(halves(r.queries))
    s = Retrieved(r.spark, r.d, plan.select(F.col("sub_id").alias("query_id"), "text"))
    found = s.lists(DEPTH).drop("doc_len", "whole").withColumn("query_id", whole_of("query_id"))
    own = retrieve.semantic(s.opened(cut_by(found, "query_id")), s.matched, s.qterms)
    return _fused(fuse.by_reranker(own, 50))


@searched
def single_index(r: Retrieved) -> DataFrame:
    return _fused(fuse.single_index(r.oracle, TOP))


@searched
def single_index_rescored(r: Retrieved) -> DataFrame:
    return _fused(fuse.rescored(r.oracle, r.matched, r.qterms, r.df_global, r.size, TOP))


# --- metrics over every hybrid query: the naive list against the list of both legs ----------------------------------


def _lists(spark, d):
    h = hits(spark, d).filter(F.col("mode") == "Hybrid")
    lists = fuse.naive(h, TOP).select("query_id", "doc_id", "stripe", F.col("fused_rank").alias("rank"))
    truth = fuse.legs(h, 50).select("query_id", "doc_id", F.col("fused_rank").alias("rank"))
    queries = read_table(spark, d, "candidates").select("query_id").distinct()
    return queries, lists, truth


def _judgments(spark, d):
    """Grades 0 to 3 from the similarity of a hit."""
    h = hits(spark, d).filter("mode = 'Hybrid' and vector_similarity is not null and vector_similarity <= 1")
    return h.groupBy("query_id", "doc_id").agg(F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.max("vector_similarity") * 4))).cast("int").alias("grade"))


_add("ndcg", lambda s, d: _six(metrics.ndcg(*_lists(s, d), TOP)))
_add("overlap_at_k", lambda s, d: _six(metrics.overlap(*_lists(s, d), TOP)))
_add("kendall_tau", lambda s, d: _six(metrics.kendall(*_lists(s, d))))
_add("rbo", lambda s, d: _six(metrics.rbo(*_lists(s, d), TOP)))
_add("identical_topk", lambda s, d: metrics.identical(*_lists(s, d), TOP))
_add("judged_ndcg", lambda s, d: _six(metrics.judged_ndcg(*_lists(s, d)[:2], _judgments(s, d), TOP)))
_add("judged_coverage", lambda s, d: _six(metrics.coverage(*_lists(s, d)[:2], _judgments(s, d), TOP)))
_add("stripe_contribution", lambda s, d: metrics.stripe_mix(_lists(s, d)[1]).select("query_id", "stripe_mix"))


@query
def judgment_pool(spark, d):
    _, lists, truth = _lists(spark, d)
    return evaluate.judgment_pool(lists, truth)


@searched
def evaluate_matrix(r: Retrieved) -> DataFrame:
    """Every strategy that needs no service, per query of the query set, against the un-split index."""
    c = r.candidates
    truth = durable_by(fuse.single_index(r.oracle, TOP).select("query_id", "doc_id", F.col("fused_rank").alias("rank")), "query_id")
    plans = {
        "naive-score": fuse.naive(c, TOP),
        "global-rrf": fuse.rrf(c, TOP),
        "minmax-norm": fuse.minmax(c, TOP),
        "zscore-norm": fuse.zscore(c, TOP),
        "global-bm25": fuse.rescored_in_search(c, TOP),
        "idf-correct-probe": fuse.idf_corrected(c, _factors(r), TOP),
    }
    out = None
    for name, p in plans.items():
        m = metrics.overlap(r.queries, p.select("query_id", "doc_id", F.col("fused_rank").alias("rank")), truth, TOP)
        one = m.select("query_id", F.lit(name).alias("strategy"), "recall", "jaccard")
        out = one if out is None else out.unionByName(one)
    return _six(out)


@query
def evaluate_all(spark, d):
    """Queries x modes x strategies with every metric; ``evaluate_matrix`` is a part of it over the stated query set."""
    return _six(matrix.matrix(spark, d, _judgments(spark, d)))


@query
def judgment_pool_all(spark, d):
    return matrix.pool(spark, d)


# --- evaluation records -------------------------------------------------------------------------------------------

BASELINE = "single-index"


def _records(spark, d):
    return evaluate.once(read_table(spark, d, "eval_records"))


def _spans(spark, d):
    """The span of each query, where it is written plainly."""
    q = read_table(spark, d, "eval_queries").select("query_id", F.lower(F.regexp_replace("span", r"[^A-Za-z]", "")).alias("s"))
    named = q.select("query_id", F.when(F.col("s") == "stripelocal", "StripeLocal").when(F.col("s") == "crossstripe", "CrossStripe").alias("span")).dropna()
    return named.groupBy("query_id").agg(F.min("span").alias("span"))


def _named_spans(spark, d):
    """The span each query's label evidently names, from the last delivery with a recognisable one."""
    q = read_table(spark, d, "eval_queries").filter("query_id is not null").select("query_id", "received_at", labels.category(F.col("span"), labels.CATEGORIES["span"]).alias("span"))
    return q.dropna(subset=["span"]).groupBy("query_id").agg(F.max_by("span", F.struct("received_at", "span")).alias("span"))


def _summary(spark, d):
    return evaluate.strategy_summary(_records(spark, d))


def _differences(spark, d):
    return significance.differences(significance.first_per_query(_records(spark, d), "judged_ndcg", "record_id"), BASELINE)


_add("strategy_summary", lambda s, d: _six(_summary(s, d)))
_add("span_breakdown", lambda s, d: _six(evaluate.span_breakdown(_records(s, d), _spans(s, d))))
_add("span_breakdown_named", lambda s, d: _six(evaluate.span_breakdown(_records(s, d), _named_spans(s, d))))
_add("paired_differences", lambda s, d: _six(significance.summary(_differences(s, d))))
_add("paired_t", lambda s, d: _six(significance.paired_t(_differences(s, d))))
_add("wilcoxon", lambda s, d: _six(significance.wilcoxon(_differences(s, d))))
_add("effect_size", lambda s, d: _six(significance.effect(_differences(s, d))))
_add("bootstrap_ci", lambda s, d: _six(significance.bootstrap_ci(_differences(s, d))))
_add("holm", lambda s, d: _six(significance.holm(significance.paired_t(_differences(s, d)), "t_p", ["mode"]).select("mode", "strategy", "p_holm")))
_add("significance_table", lambda s, d: _six(significance.table(_records(s, d), "judged_ndcg", "record_id", BASELINE).select("mode", "strategy", "n", "mean", "ci_low", "ci_high", "wins", "losses", "ties", "t", "t_p", "w_p", "cohens_d", "p_holm")))


@query
def formatted_significance(spark, d):
    """Figures as reports print them: signed with three decimals, p values, a dash for none."""
    x = _differences(spark, d)
    t = significance.summary(x).join(significance.paired_t(x), significance.GROUP)
    quality = _records(spark, d).groupBy("mode", "strategy").agg(F.round(F.avg("agentic_tokens"), 6).alias("tokens"))
    both = t.join(quality, significance.GROUP)
    return both.select("mode", "strategy", text.fixed(F.round("mean", 6), 3, signed=True).alias("mean"), text.p_value(F.round("t_p", 6)).alias("p"), text.fixed(F.col("tokens"), 1).alias("tokens"))


@query
def compare(spark, d):
    """Two arms by query id: fidelity of global-rrf less naive-score, uncorrected."""
    v = significance.first_per_query(_records(spark, d).filter(F.col("strategy").isin("naive-score", "global-rrf")), "ndcg", "record_id")
    x = significance.differences(v, "naive-score")
    return _six(significance.summary(x).join(significance.paired_t(x), significance.GROUP))


def _semantic_names() -> list[str]:
    return [s.name for s in STRATEGIES if s.needs_semantic]


@query
def cost_tradeoff(spark, d):
    """The ranker of a strategy with a second stage runs once for each stripe that its records name, on average."""
    stripes = F.size(F.split("stripe_mix", r" \| ")).cast("double")
    calls = _records(spark, d).filter(F.col("strategy").isin(_semantic_names()) & F.col("stripe_mix").isNotNull()).groupBy("strategy").agg(F.avg(stripes).alias("ranker_calls"))
    return _six(evaluate.cost_tradeoff(_summary(spark, d), BASELINE, calls), 8)


@query
def compute_model(spark, d):
    h = hits(spark, d).groupBy("query_id", "mode").agg(F.countDistinct("stripe").alias("indexes"), F.count(F.lit(1)).alias("results"))
    return h.select("query_id", "mode", F.round(evaluate.compute_model(F.col("indexes"), F.col("results")), 9).alias("compute_units"))


@query
def query_accounting(spark, d):
    """Every strategy of the catalog charged with the requests that the delivered hits stand for: the shared fan-out, or a retrieval of its own from each stripe."""
    c = read_table(spark, d, "candidates")
    fan = c.groupBy("query_id", "stripe").agg(F.countDistinct("mode").alias("requests"), F.count(F.lit(1)).alias("n"))
    units = evaluate.compute_model(F.lit(1), F.col("n"))
    shared = fan.select("query_id", F.lit(None).cast("string").alias("strategy"), "requests", units.alias("compute_units"), F.col("n").cast("double").alias("elapsed_ms"))
    alone = F.explode(F.array(*[F.lit(s.name) for s in STRATEGIES if s.own_retrieval])).alias("strategy")
    own = fan.select("query_id", alone, F.lit(1).cast("long").alias("requests"), (units / F.col("requests")).alias("compute_units"), (F.col("n") / F.col("requests")).alias("elapsed_ms"))
    names = spark.createDataFrame([(s.name, s.own_retrieval) for s in STRATEGIES], "strategy string, own_retrieval boolean")
    return _six(evaluate.accounting(shared.unionByName(own), names))


@searched
def probe_cache(r: Retrieved) -> DataFrame:
    asked = r.qterms.select("term", number_of("query_id").alias("query_no"), F.explode(F.array(*[F.lit(s) for s in STRIPES])).alias("stripe"))
    return evaluate.first_probes(asked).groupBy("query_no").agg(F.count(F.lit(1)).alias("probes"))


@query
def apply_judgments(spark, d):
    queries, lists, _ = _lists(spark, d)
    scores = metrics.coverage(queries, lists, _judgments(spark, d), TOP)
    r = _records(spark, d).select("record_id", "query_id", "mode", "strategy")
    return _six(evaluate.apply_judgments(r, scores).select("record_id", "judged_coverage"))


@searched
def explain_query(r: Retrieved) -> DataFrame:
    """What a query is answered with: the first ten of each stripe with their subscores, the fused list with its explanation, and the stripes' parts of it."""
    c = r.candidates
    part = lambda df, name, **more: df.select("query_id", F.lit(name).alias("part"), *[more.get(x, F.lit(None)).cast(t).alias(x) for x, t in (("stripe", "string"), ("place", "int"), ("doc_id", "long"), ("score", "double"), ("text_score", "double"), ("reranker_score", "double"), ("explanation", "string"))])
    per = part(c.filter("hit_rank <= 10"), "stripe", place=F.col("hit_rank"), **{x: F.col(x) for x in ("stripe", "doc_id", "score", "text_score", "reranker_score")})
    lists = fuse.rrf(c, TOP, explain=True)
    fused = part(lists, "fused", stripe=F.col("stripe"), place=F.col("fused_rank"), doc_id=F.col("doc_id"), score=F.col("fused_score"), explanation=F.col("explanation"))
    mix = part(metrics.stripe_mix(lists), "mix", explanation=F.col("stripe_mix"))
    return _six(per.unionByName(fused).unionByName(mix), 9)


@query
def verify_counts(spark, d):
    return tables.stripe_catalog(read_table(spark, d, "documents"))


@query
def doctor(spark, d):
    """Checks of what the engine needs, one row each: vectors, stripes, subscores, statistics and the second stage."""
    e = read_table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size("embedding")).alias("sizes"))
    c = read_table(spark, d, "candidates").agg(*[F.count(x).alias(x) for x in ("text_score", "vector_similarity", "reranker_score")], F.max("reranker_score").alias("most"), F.min("reranker_score").alias("least"))
    s = tables.stripe_catalog(read_table(spark, d, "documents").filter("stripe is not null")).agg(F.count(F.lit(1)).alias("stripes"), F.min("n_docs").alias("fewest"))
    i = index_of(spark, d)
    known = i.sizes.join(i.df_local.groupBy("stripe").agg(F.count(F.lit(1)).alias("terms")), "stripe", "left").agg(F.min(F.coalesce("terms", F.lit(0))).alias("terms"), F.min("avgdl").alias("avgdl"))

    def row(df: DataFrame, name: str, ok: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"))

    out = row(e, "vectors", F.col("n") > 0).unionByName(row(e, "one vector size", F.col("sizes") == 1)).unionByName(row(s, "stripes", F.col("stripes") >= 2)).unionByName(row(s, "no empty stripe", F.col("fewest") > 0))
    for x in ("text_score", "vector_similarity", "reranker_score"):
        out = out.unionByName(row(c, f"{x} present", F.col(x) > 0))
    second = row(c, "second stage within 0 to 4", (F.col("least") >= 0) & (F.col("most") <= 4))
    return out.unionByName(second).unionByName(row(known, "statistics of every stripe", (F.col("terms") > 0) & (F.col("avgdl") > 0)))


@query
def result_rows(spark, d):
    """The cells of a results file; figures are read back from their text."""
    r = _records(spark, d)
    return tables.result_rows(r).select("queryId", "mode", "strategy", F.col("judgedNdcg").cast("double").alias("judgedNdcg"), F.col("agenticTokens").cast("long").alias("agenticTokens"), "stripeMix").distinct()


def _counted_words(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: characters, blanks and the letter e of a text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query
def embed_pending(spark, d):
    """Documents without a vector, embedded in batches of 96 by the stand-in model."""
    todo = prep.pending(read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])
    got = prep.embedded(todo, "doc_id", "text", _counted_words)
    return got.select("doc_id", *[F.col("embedding")[i].alias(x) for i, x in enumerate(("characters", "blanks", "es"))])


@query
def query_embeddings(spark, d):
    """Evaluation queries with the vector that is known for their text: the label of the vector whose document has it as title."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("title").alias("text"))
    known = read_table(spark, d, "embeddings").join(docs, "vec_id").select("text", F.array(F.col("label").cast("double")).alias("embedding"))
    asked = docs.select(F.col("vec_id").alias("query_id"), "text")
    return prep.looked_up(asked, known).select("query_id", F.col("embedding")[0].alias("label"))


for _name, _plan in files.QUERIES.items():
    _add(_name, _plan)


# --- two judges: the first two raters of a document -----------------------------------------------------------------


def _pairs(spark, d):
    r = read_table(spark, d, "reading_labels").filter("reading_level between 1 and 5").groupBy("doc_id", "rater").agg(F.max("reading_level").alias("level"))
    both = r.groupBy("doc_id").agg(F.min(F.struct("rater", "level")).alias("a"), F.max(F.struct("rater", "level")).alias("b")).filter("a.rater <> b.rater")
    grade = lambda c: F.least(F.lit(3), F.col(f"{c}.level") - 1)
    return both.select("doc_id", grade("a").alias("g1"), grade("b").alias("g2"))


_add("weighted_kappa", lambda s, d: _six(significance.kappa(_pairs(s, d))))
_add("judge_agreement", lambda s, d: _six(significance.agreement(_pairs(s, d))))
_add("confusion_matrix", lambda s, d: significance.confusion(_pairs(s, d)))
_add("grade_histogram", lambda s, d: _six(significance.histogram(read_table(s, d, "reading_labels"), "reading_level")))


@query
def normal_functions(spark, d):
    v = read_table(spark, d, "candidates").filter("vector_similarity > 0 and vector_similarity < 1").select(F.col("vector_similarity").alias("p")).distinct()
    return _six(v.select("p", statistics.normal_quantile(F.col("p")).alias("z"), statistics.normal_cdf(F.col("p")).alias("cdf")))


# --- preparing a corpus -------------------------------------------------------------------------------------------


def _tags(spark):
    return prep.genre_map(spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(GENRE_TAGS)], "tag string, genre string, place int"))


def _tag_counts(spark, d):
    return read_table(spark, d, "books").filter("genre is not null and book_id is not null").select("book_id", F.col("genre").alias("tag"), F.coalesce("ratings_count", F.lit(0)).alias("count"))


@query
def tag_genre_map(spark, d):
    return _tag_counts(spark, d).withColumn("tag_lower", F.lower("tag")).join(_tags(spark), "tag_lower").groupBy("tag", "genre").agg(F.count(F.lit(1)).alias("n"))


@query
def genre_totals(spark, d):
    return prep.genre_totals(_tag_counts(spark, d), _tags(spark))


@query
def primary_genre(spark, d):
    books = read_table(spark, d, "books").filter("book_id is not null").select("book_id").distinct()
    p = prep.primary_genre(books, prep.genre_lists(prep.genre_totals(_tag_counts(spark, d), _tags(spark))))
    return p.select("book_id", "primary_genre", F.array_join("genres", ",").alias("genres"))


_add("category_counts", lambda s, d: prep.category_counts(prep.catalog(read_table(s, d, "books")), "genre"))
_add("blurb_join", lambda s, d: prep.with_text(read_table(s, d, "books").select("book_id").distinct(), read_table(s, d, "documents"), "book_id", "text").groupBy("book_id").agg(F.count(F.lit(1)).alias("n")))
_add("pending_rows", lambda s, d: prep.pending(read_table(s, d, "documents").select("doc_id"), read_table(s, d, "reading_labels"), ["doc_id"]))


@query
def upsert(spark, d):
    r = read_table(spark, d, "eval_records").select("record_id", "latency_ms", "ingested_at").filter("record_id is not null")
    cut = F.lit("2026-03-15").cast("timestamp")
    u = prep.upsert(r.filter(F.col("ingested_at") < cut), r.filter(F.col("ingested_at") >= cut), ["record_id"], "ingested_at")
    return u.select("record_id", F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"))


_add("stride_sample", lambda s, d: prep.stride_sample(read_table(s, d, "documents").select("doc_id"), ["doc_id"], 300))
_add("stride_sample_int", lambda s, d: prep.stride_sample_int(read_table(s, d, "documents").select("doc_id"), ["doc_id"], 300))


@query
def latency_windows(spark, d):
    """The streaming aggregate over the finite events table: tumbling hours."""
    from ..streaming.increment import windowed_latency

    w = windowed_latency(read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    return _six(w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "mean", "largest"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as sql

    return sql()
