"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from . import mixing, percentiles, quota_sample, readability, score_fusion, terms, tokens, topn
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
GROUP = ["run_id", "mode", "strategy"]
SHARES = {"p50": 0.5, "p95": 0.95}
SCORES = ["score", "text_score", "vector_similarity", "reranker_score"]
TOLERANCE = 0.12


def _terms(spark: SparkSession, d: str) -> DataFrame:
    got, records = terms.split(terms.term_statistics(table(spark, d, "documents")))
    return terms.marked(got, sum(records.values()))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its document frequency, occurrences, mark, and one row per stripe that holds it."""
    flat = _terms(spark, d).select("term", "document_frequency", "occurrences", "mark", F.explode("stripes").alias("s"))
    return flat.select("term", "document_frequency", "occurrences", "mark", F.col("s.stripe").alias("stripe"), F.col("s.document_frequency").alias("local_document_frequency"), F.col("s.occurrences").alias("local_occurrences"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark is not null").select("term", "mark")


def _latency(spark: SparkSession, d: str) -> DataFrame:
    records = percentiles.once(table(spark, d, "eval_records"), "record_id", [*GROUP, "run_day", "latency_ms"], "ingested_at")
    days = percentiles.digests(records, [*GROUP, "run_day"], "latency_ms")
    return percentiles.with_quantiles(percentiles.merge(days, GROUP), SHARES)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d).select(*GROUP, "n", *[F.round(c, 3).alias(c) for c in SHARES])


def p2_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile is within 0.01 % of the exact one, as it is where no digest was compressed."""
    records = percentiles.once(table(spark, d, "eval_records"), "record_id", [*GROUP, "latency_ms"], "ingested_at")
    measured = records.withColumn("latency_ms", F.when((F.col("latency_ms") > 0) & ~F.isnan("latency_ms"), F.col("latency_ms")))
    exact = ranks.percentiles(measured, GROUP, "latency_ms", SHARES)
    both = _latency(spark, d).alias("a").join(exact.alias("e"), ranks.same("a", "e", GROUP))
    return both.select(*[F.col(f"a.{k}") for k in GROUP], "a.n", *[(F.abs(F.col(f"a.{p}") / F.col(f"e.{p}") - 1) < 1e-4).alias(f"{p}_close") for p in SHARES])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "strategy_summaries").select("summary_id", *GROUP, "latency_p50_ms", "latency_p95_ms")
    wrong = percentiles.off_by(said, _latency(spark, d), GROUP, [("latency_p50_ms", "p50"), ("latency_p95_ms", "p95")], TOLERANCE)
    return wrong.select("summary_id").distinct()


def _hybrid(spark: SparkSession, d: str, **how: int) -> DataFrame:
    hits = table(spark, d, "candidates").filter(F.col("mode") == "Hybrid")
    return score_fusion.fuse_scores(hits, "query_id", "doc_id", SCORES, **how)


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


def p3_by_range(spark: SparkSession, d: str) -> DataFrame:
    """The same with every query over 200 hits ranked by ranges, the way that hot queries go."""
    return _hybrid(spark, d, hot_rows=200)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return score_fusion.first_items(_hybrid(spark, d), "query_id", "doc_id", 3).select("query_id", "doc_id")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return terms.term_weights(docs, docs).withColumn("weight", F.round("weight", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    probes = table(spark, d, "doc_probes").select("doc_id").distinct()
    return terms.most_characteristic(terms.term_weights(docs, docs.join(probes, "doc_id", "left_semi")))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.quota_plan(table(spark, d, "eval_queries"), table(spark, d, "sample_targets"))


def p5_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def p5_margins(spark: SparkSession, d: str) -> DataFrame:
    """The margins of every set's quotas, and whether each is the margin of its needs rounded down or up."""
    plan = _plan(spark, d)
    sides = F.inline(F.array(F.struct(F.lit("all").alias("margin"), F.lit("").alias("label")), F.struct(F.lit("shape").alias("margin"), F.col("shape").alias("label")), F.struct(F.lit("span, intent").alias("margin"), F.concat_ws(", ", "span", "intent").alias("label"))))
    sums = plan.select("set_id", "need", "quota", sides).groupBy("set_id", "margin", "label").agg(F.round(F.sum("need"), 6).alias("need"), F.sum("quota").alias("quota"))
    return sums.select("set_id", "margin", "label", "need", ((F.col("quota") >= F.floor("need")) & (F.col("quota") <= F.ceil("need"))).alias("kept"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.draw(table(spark, d, "eval_queries"), _plan(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).filter("short").select("set_id", "shape", "span", "intent")


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "fused_docs"), table(spark, d, "fusion_contexts"), "list_id", "doc_id", "fused_score", "top_k")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d).select("list_id", "doc_id", "fused_score", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d).select("list_id", "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), ["doc_id"])


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(mixing.source_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def _laid(spark: SparkSession, d: str) -> mixing.Laid:
    return mixing.lay_out(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_laid(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(_laid(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).filter("not reached").select("mix_id", "source")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("level >= 4").select("doc_id")


def queries() -> dict[str, Query]:
    found = [p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_ids, p8_found, p9_found]
    more = [p1_terms, p2_percentiles, p2_within, p3_ranking, p3_by_range, p4_weights, p5_plan, p5_margins, p5_sample, p6_ranked, p8_plan, p8_mix, p8_shares, p9_levels]
    return {f.__name__: f for f in [*found, *more]}


_COUNTED = r"""
WITH t AS (SELECT doc_id, stripe, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]{2,}')) AS term FROM documents),
     d AS (SELECT doc_id, stripe, term, count(*) AS tf FROM t GROUP BY ALL),
     n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
     g AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM d GROUP BY term),
     m AS (SELECT term, df, cf, CASE WHEN df <= 2 THEN 'rare' WHEN df > round(n * 0.38::DOUBLE, 6) THEN 'common' END AS mark FROM g, n)"""

#: Languages by the profile of ``terms.language_profile``, where its sample holds every labelled document (up to 20,000 of them), and the weights.
_WEIGHTED = (
    _COUNTED
    + r""",
     lb AS (SELECT doc_id, nullif(substr(lower(regexp_replace(lang, '[^\p{L}]', '', 'g')), 1, 2), '') AS code FROM documents),
     ls AS (SELECT code, count(*) AS size FROM lb WHERE code IS NOT NULL GROUP BY code ORDER BY size DESC, code LIMIT 50),
     lk AS (SELECT * FROM ls WHERE size * 1000 >= (SELECT sum(size) FROM ls)),
     lc AS (SELECT code, term, count(*) AS c FROM d JOIN lb USING (doc_id) WHERE code IN (SELECT code FROM lk) GROUP BY ALL),
     lw AS (SELECT DISTINCT term FROM (SELECT term, row_number() OVER (PARTITION BY code ORDER BY c DESC, term) AS p FROM lc) WHERE p <= 100),
     lg AS (SELECT lw.term, lk.code, ln((coalesce(c, 0) + 0.5::DOUBLE) / (size + 1::DOUBLE)) AS g FROM lw CROSS JOIN lk LEFT JOIN lc ON lc.term = lw.term AND lc.code = lk.code),
     sc AS (SELECT doc_id, code, sum(g) AS s FROM d JOIN lg ON d.term = lg.term GROUP BY ALL),
     bs AS (SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, code) AS p FROM sc) WHERE p = 1),
     la AS (SELECT lb.doc_id, coalesce(bs.code, lb.code, '') AS l FROM lb LEFT JOIN bs USING (doc_id)),
     ln AS (SELECT l, count(*)::DOUBLE AS nl FROM (SELECT DISTINCT doc_id FROM d) JOIN la USING (doc_id) GROUP BY l),
     lt AS (SELECT term, l, sum(tf) AS cl FROM d JOIN la USING (doc_id) GROUP BY ALL),
     ex AS (SELECT term, sum(nl * (1 - exp(-cl / nl))) AS would FROM lt JOIN ln USING (l) GROUP BY term),
     w AS (SELECT doc_id, d.term, tf, df, cf, round((1 + ln(tf)) * log2(would / df), 9) AS weight FROM d JOIN g ON d.term = g.term JOIN ex ON ex.term = d.term)"""
)


def _category_sql(column: str, names: list[str]) -> str:
    raw = f"lower(regexp_replace({column}, '[^\\p{{L}}\\p{{Nd}}.-]', '', 'g'))"
    word = f"lower(regexp_replace({column}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
    far = [f"levenshtein({word}, '{n.lower()}')" for n in names]
    near = f"least({', '.join(far)})"
    cases = []
    for i, n in enumerate(names):
        alone = " AND ".join(f"{far[j]} > {far[i]}" for j in range(len(names)) if j != i)
        cases.append(f"WHEN regexp_extract({raw}, '^\\.*0*(\\d+)(?:\\.0*)?\\.?$', 1) = '{i}' OR {word} = '{n.lower()}' OR ({near} <= 2 AND {alone} AND {near} * 2 <= {len(n)}) THEN '{n}'")
    return f"CASE WHEN length({word}) = 0 OR {column} IS NULL THEN NULL {' '.join(cases)} END"


def oracle_sql() -> dict[str, str]:
    cats = quota_sample.CATEGORIES
    labels = ", ".join(f"{_category_sql(c, v)} AS {c}" for c, v in cats.items())
    last = ", ".join(f"arg_max({c}, received_at) FILTER ({c} IS NOT NULL) AS {c}" for c in cats)
    rrf = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 / (60::DOUBLE + rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST)) END" for s in SCORES)
    best = ", ".join(f"max(CASE WHEN NOT isnan({s}) THEN {s} END) AS {s}" for s in SCORES)
    fused = f"WITH b AS (SELECT query_id, doc_id, {best} FROM candidates WHERE mode = 'Hybrid' AND query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), f AS (SELECT query_id, doc_id, round({rrf}, 12) AS total FROM b)"
    tops = """WITH b AS (SELECT list_id, doc_id, max(fused_score + 0.0::DOUBLE) AS fused_score FROM fused_docs WHERE fused_score IS NOT NULL AND NOT isnan(fused_score) AND doc_id IS NOT NULL GROUP BY ALL),
        l AS (SELECT list_id, max(top_k) AS top_k FROM fusion_contexts WHERE top_k >= 1 GROUP BY ALL),
        r AS (SELECT b.*, top_k, row_number() OVER (PARTITION BY list_id ORDER BY fused_score DESC, doc_id) AS rank FROM b JOIN l USING (list_id))"""
    latency = """WITH r AS (SELECT record_id, arg_max(struct_pack(run_id := run_id, mode := mode, strategy := strategy, l := latency_ms), ingested_at) AS r FROM eval_records GROUP BY record_id),
        g AS (SELECT r.run_id AS run_id, r.mode AS mode, r.strategy AS strategy, quantile_disc(r.l, 0.5) AS p50, quantile_disc(r.l, 0.95) AS p95 FROM r WHERE r.l > 0 AND NOT isnan(r.l) GROUP BY ALL)"""
    return {
        "p1_found": _COUNTED + " SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p1_terms": _COUNTED + " SELECT m.term, m.df AS document_frequency, m.cf AS occurrences, m.mark, stripe, count(*) AS local_document_frequency, sum(tf)::BIGINT AS local_occurrences FROM d JOIN m ON d.term = m.term GROUP BY ALL",
        "p2_found": latency
        + " SELECT DISTINCT summary_id FROM strategy_summaries s JOIN g ON s.run_id IS NOT DISTINCT FROM g.run_id AND s.mode IS NOT DISTINCT FROM g.mode AND s.strategy IS NOT DISTINCT FROM g.strategy WHERE abs(latency_p50_ms - p50) > p50 * 0.12::DOUBLE OR abs(latency_p95_ms - p95) > p95 * 0.12::DOUBLE",
        "p2_within": latency + ", c AS (SELECT r.run_id AS run_id, r.mode AS mode, r.strategy AS strategy, count(*) AS n FROM r WHERE r.l > 0 AND NOT isnan(r.l) GROUP BY ALL) SELECT run_id, mode, strategy, n, TRUE AS p50_close, TRUE AS p95_close FROM c",
        "p3_found": fused + " SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS place FROM f) WHERE place <= 3",
        "p3_ranking": fused + " SELECT query_id, doc_id, total FROM f",
        "p3_by_range": fused + " SELECT query_id, doc_id, total FROM f",
        "p4_found": _WEIGHTED + " SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS place FROM w WHERE doc_id IN (SELECT doc_id FROM doc_probes)) WHERE place = 1",
        "p4_weights": _WEIGHTED + " SELECT doc_id, term, tf, df AS document_frequency, cf AS occurrences, round(weight, 6) AS weight FROM w",
        "p5_margins": """WITH t AS (SELECT set_id, shape, span, intent, max(greatest(round(coalesce(target_share, 0) * coalesce(sample_size, 0), 6), coalesce(min_rows, 0))) AS need FROM sample_targets GROUP BY ALL),
            m AS (SELECT set_id, 'all' AS margin, '' AS label, need FROM t UNION ALL SELECT set_id, 'shape', shape, need FROM t UNION ALL SELECT set_id, 'span, intent', span || ', ' || intent, need FROM t)
            SELECT set_id, margin, label, round(sum(need), 6) AS need, TRUE AS kept FROM m GROUP BY ALL""",
        "p5_found": f"""WITH q AS (SELECT set_id, query_id, received_at, {labels} FROM eval_queries),
            k AS (SELECT set_id, query_id, {last} FROM q GROUP BY set_id, query_id),
            h AS (SELECT set_id, shape, span, intent, count(*) AS available FROM k WHERE shape IS NOT NULL AND span IS NOT NULL AND intent IS NOT NULL GROUP BY ALL),
            t AS (SELECT set_id, shape, span, intent, max(greatest(round(coalesce(target_share, 0) * coalesce(sample_size, 0), 6), coalesce(min_rows, 0))) AS need FROM sample_targets GROUP BY ALL)
            SELECT set_id, shape, span, intent FROM t LEFT JOIN h USING (set_id, shape, span, intent) WHERE need > coalesce(available, 0)""",
        "p6_found": tops + " SELECT list_id, doc_id FROM r WHERE rank <= top_k",
        "p6_ranked": tops + " SELECT list_id, doc_id, fused_score, rank FROM r WHERE rank <= top_k",
    }
