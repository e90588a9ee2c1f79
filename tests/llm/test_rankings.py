import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.llm import score_fusion, topn

NAN, INF = float("nan"), float("inf")


def brute_rrf(hits, scores, k=60):
    best = {}
    for q, d, *vs in hits:
        if q is None or d is None:
            continue
        cur = best.setdefault((q, d), [None] * scores)
        for i, v in enumerate(vs[:scores]):
            if v is not None and v == v and (cur[i] is None or v > cur[i]):
                cur[i] = v
    out = {}
    for (q, d), vs in best.items():
        total = 0.0
        for i, v in enumerate(vs):
            if v is not None:
                total += 1 / (k + 1 + sum(1 for (q2, _), w in best.items() if q2 == q and w[i] is not None and w[i] > v))
        out[q, d] = round(total, 12)
    return out


def hits(seed=0):
    rng = random.Random(seed)
    data = [("q%d" % rng.randint(0, 3), rng.randint(1, 40), rng.choice([None, NAN, rng.random()]), rng.choice([None, round(rng.random() * 900, 1), -1.5, 0.0]), None, 7) for _ in range(300)]
    return data + data[:20] + [(None, 1, 1.0, 1.0, None, 7), ("q1", None, 1.0, 1.0, None, 7), ("lone", 5, None, None, None, 7)]


@pytest.mark.parametrize("hot", [10**9, 75])
def test_both_ways_match_brute_force(spark, hot):
    df = spark.createDataFrame(hits(), "q string, d long, s1 double, s2 double, s3 double, total long")
    got = score_fusion.fuse_scores(df, "q", "d", ["s1", "s2", "s3"], hot_rows=hot)
    assert {(r["q"], r["d"]): r["total"] for r in got.collect()} == brute_rrf(hits(), 3)
    assert got.columns == ["q", "d", "total"]


def test_hot_queries_of_the_tables_get_the_same_totals(spark, small):
    df = spark.read.parquet(f"{small}/candidates.parquet").filter("mode = 'Hybrid'")
    scores = ["score", "text_score", "vector_similarity", "reranker_score"]
    assert rows(score_fusion.fuse_scores(df, "query_id", "doc_id", scores, hot_rows=40)) == rows(score_fusion.fuse_scores(df, "query_id", "doc_id", scores))


def test_units_do_not_matter_and_ties_go_to_the_smaller_item(spark):
    base = [("q", 1, 0.9, 10.0), ("q", 2, 0.8, 30.0), ("q", 3, 0.7, 20.0), ("q", 4, 0.7, 20.0)]
    scaled = [(q, d, a * 1e6, b / 1e6 - 5) for q, d, a, b in base]
    first = [rows(score_fusion.first_items(score_fusion.fuse_scores(spark.createDataFrame(x, "q string, d long, a double, b double"), "q", "d", ["a", "b"]), "q", "d", 3).select("place", "d")) for x in (base, scaled)]
    assert first[0] == first[1] == [(1, 2), (2, 1), (3, 3)]
    empty = spark.createDataFrame([], "q string, d long, a double, b double")
    assert score_fusion.first_items(score_fusion.fuse_scores(empty, "q", "d", ["a", "b"]), "q", "d", 3).count() == 0


def brute_top(data, limits):
    best = defaultdict(dict)
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(best[g].get(i, -INF), s)
    n = {}
    for g, k in limits:
        if g is not None and k is not None and k >= 1:
            n[g] = max(n.get(g, 0), k)
    return {(g, i): r + 1 for g in best if g in n for r, (i, _) in enumerate(sorted(best[g].items(), key=lambda x: (-x[1], x[0]))[: n[g]])}


@pytest.mark.parametrize("settings", [{}, {"salt_rows": 7}, {"salt_rows": 7, "long_list": 4}, {"long_list": 1}])
def test_top_n_matches_brute_force(spark, settings):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice([None, NAN, INF, -INF, 0.0, -0.0, -2.5, rng.random(), 1e9])) for _ in range(900)]
    limits = [(1, 7), (1, 7), (2, 2), (2, 3), (3, None), (4, 5), (5, 0), (None, 3)]
    h = spark.createDataFrame(data, "g long, i long, s double").withColumn("n", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("_s", F.lit(2))
    li = spark.createDataFrame(limits, "g long, n int").withColumn("s", F.lit("clash"))
    got = {(r["g"], r["i"]): r["rank"] for r in topn.top_n(h, li, "g", "i", "s", "n", **settings).collect()}
    assert got == brute_top(data, limits)


def test_every_way_gives_the_same_lists_of_the_tables(spark, small):
    h, li = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("fused_docs", "fusion_contexts"))
    top = lambda **how: rows(topn.top_n(h, li, "list_id", "doc_id", "fused_score", "top_k", **how))
    want = top()
    assert want == top(salt_rows=5) == top(long_list=10)


def test_many_large_groups_are_salted_alike(spark, monkeypatch):
    h = spark.createDataFrame([(g, i, float(i * 7 % 11)) for g in range(4) for i in range(40)], "g long, i long, s double")
    li = spark.createDataFrame([(g, 3 + g) for g in range(4)], "g long, n int")
    want = rows(topn.top_n(h, li, "g", "i", "s", "n"))
    monkeypatch.setattr(topn, "FEW_KEYS", 1)
    assert rows(topn.top_n(h, li, "g", "i", "s", "n", salt_rows=5)) == want == rows(topn.top_n(h, li, "g", "i", "s", "n", long_list=4))


def test_top_n_of_empty_tables(spark):
    h = spark.createDataFrame([(1, 2, 3.0)], "g long, i long, s double")
    li = spark.createDataFrame([(1, 5)], "g long, n int")
    assert topn.top_n(h.limit(0), li, "g", "i", "s", "n").count() == 0 and topn.top_n(h, li.limit(0), "g", "i", "s", "n").count() == 0
