"""Fusion strategies against plain-Python versions on generated candidates, and cases worked out by hand."""

import math
import random
from collections import defaultdict
from statistics import fmean, pstdev

import pytest
from conftest import rows

from rankweave.operators import fuse
from rankweave.plans.catalog import Registry

SCHEMA = "query_id string, mode string, stripe string, stripe_pos int, doc_id long, hit_rank int, score double, text_score double, vector_similarity double, reranker_score double"
STRIPE = {"north": 0, "south": 1, "west": 2}


def generated(seed):
    """Lists of three stripes, some of which do not answer; documents shared by stripes, equal scores, missing legs, null keys."""
    rng = random.Random(seed)
    out = []
    for q in ("harbour", "lantern", "quarry", None):
        for mode in ("Keyword", "Hybrid", None):
            for stripe, pos in STRIPE.items():
                n = rng.choice([0, 0, 1, 4, 7])
                scores = sorted((round(rng.choice([rng.random(), 0.5]) * (1 + 40 * pos), 3) for _ in range(n)), reverse=True)
                for i, (d, s) in enumerate(zip(rng.sample(range(12), n), scores), start=1):
                    leg = lambda x: rng.choice([None, round(rng.random() * x, 2)])
                    out.append((q, mode, stripe, pos, d, i, s, leg(9), leg(1), leg(4)))
    return out


def brute(hits, score_of, k, digits=9):
    """score_of(list, hit) gives a hit's score or None; a document keeps its best, then the earlier stripe, then the better rank."""
    lists = defaultdict(list)
    for h in hits:
        lists[h[0], h[1]].append(h)
    out = []
    for key, members in lists.items():
        best = {}
        for h in members:
            s = score_of(members, h)
            if s is not None:
                mine = (-round(s, digits), h[3], h[5])
                if h[4] not in best or mine < best[h[4]][0]:
                    best[h[4]] = (mine, h[2])
        order = sorted(best.items(), key=lambda x: (x[1][0][0], x[0]))[:k]
        out += [(*key, d, stripe, -m[0] + 0.0, i) for i, (d, (m, stripe)) in enumerate(order, start=1)]
    return sorted(out, key=repr)


def own_stripe(members, h):
    return [x[6] for x in members if x[2] == h[2]]


def interleaved(members, h):
    there = sorted({x[3] for x in members})
    return -(h[5] - 1 + there.index(h[3]) / len(there))


def stretched(members, h):
    s = own_stripe(members, h)
    return (h[6] - min(s)) / (max(s) - min(s)) if max(s) > min(s) else 1.0


def standard(members, h):
    s = own_stripe(members, h)
    return (h[6] - fmean(s)) / pstdev(s) if max(s) > min(s) else 0.0


def both_legs(members, h):
    total, any_leg = 0.0, False
    for leg in (7, 8):
        if h[leg] is not None:
            order = sorted((x for x in members if x[leg] is not None), key=lambda x: (-x[leg], x[4], x[3]))
            total += 1 / (60 + order.index(h) + 1)
            any_leg = True
    return total if any_leg else None


PLANS = {
    "naive": (fuse.naive, lambda m, h: h[6], 12),
    "interleave": (fuse.interleave, interleaved, 9),
    "rrf": (fuse.rrf, lambda m, h: 1 / (60 + h[5]), 9),
    "minmax": (fuse.minmax, stretched, 9),
    "zscore": (fuse.zscore, standard, 9),
    "by_vector": (fuse.by_vector, lambda m, h: h[8], 9),
    "by_reranker": (fuse.by_reranker, lambda m, h: h[9], 9),
    "legs": (fuse.legs, both_legs, 9),
    "legs of hot queries": (lambda c, k: fuse.legs(c, k, hot_rows=3), both_legs, 9),
}


@pytest.mark.parametrize("name", PLANS)
@pytest.mark.parametrize("seed", [3, 11])
def test_strategies_match_brute_force(spark, name, seed):
    plan, score_of, digits = PLANS[name]
    hits = generated(seed)
    got = [(q, m, d, s, round(x, digits) + 0.0, r) for q, m, d, s, x, r in rows(plan(spark.createDataFrame(hits, SCHEMA), 5))]
    want = [(q, m, d, s, round(x, digits), r) for q, m, d, s, x, r in brute(hits, score_of, 5, digits)]
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:4] == w[:4] and g[5] == w[5] and g[4] == pytest.approx(w[4], abs=2e-9)


@pytest.mark.parametrize("name", PLANS)
def test_no_candidates_no_list(spark, name):
    assert rows(PLANS[name][0](spark.createDataFrame([], SCHEMA), 5)) == []


def ranked(df):
    return [r["doc_id"] for r in df.orderBy("fused_rank").collect()]


def lists(spark, **stripes):
    """Candidates of one query: stripe=[(doc, score), ...] in the order of its list."""
    return spark.createDataFrame([("harbour", "Keyword", s, STRIPE[s], d, i, float(x), None, None, None) for s, hits in stripes.items() for i, (d, x) in enumerate(hits, start=1)], SCHEMA)


def test_a_single_answering_stripe_is_numbered_first(spark):
    """Two stripes of three answer: the later of them is one half behind, not two thirds, and alone it is not behind at all."""
    two = lists(spark, south=[(41, 8), (42, 7)], west=[(51, 0.3)])
    assert {r["doc_id"]: r["fused_score"] for r in fuse.interleave(two).collect()} == {41: 0.0, 51: -0.5, 42: -1.0}
    alone = lists(spark, west=[(51, 0.3), (52, 0.1)])
    assert [r["fused_score"] for r in fuse.interleave(alone).orderBy("fused_rank").collect()] == [0.0, -1.0]


def test_rrf_sum_adds_what_rrf_does_not(spark):
    c = lists(spark, north=[(7, 3.0), (8, 2.0)], south=[(9, 90.0), (7, 80.0)])
    assert ranked(fuse.rrf(c)) == [7, 9, 8]
    sums = {r["doc_id"]: r["fused_score"] for r in fuse.rrf_sum(c).collect()}
    assert sums[7] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and sums[8] == pytest.approx(1 / 62, abs=1e-9)


def test_quota_follows_sizes(spark):
    c = lists(spark, north=[(i, 9 - i) for i in range(8)], south=[(20 + i, 90 - i) for i in range(8)], west=[(40, 1)])
    sizes = spark.createDataFrame([("north", 700), ("south", 280), ("west", 1)], "stripe string, n_docs long")
    got = fuse.quota(c, sizes, 10).groupBy("stripe").count()
    assert dict(rows(got)) == {"north": 6, "south": 3, "west": 1}  # quotas 7, 3 and 1; of these eleven the seventh of the north has the worst rank
    assert rows(fuse.quota(c, sizes.filter("stripe = 'east'"), 10)) == []
    assert dict(rows(fuse.quota(c, sizes.filter("stripe <> 'south'"), 20).groupBy("stripe").count())) == {"north": 8, "south": 1, "west": 1}


def test_a_run_without_reranker_scores_is_an_error(spark):
    c = lists(spark, north=[(1, 2.0)])
    assert rows(fuse.by_reranker(c)) == []
    with pytest.raises(Exception, match="no candidate has a reranker score"):
        fuse.by_reranker(c, strict=True).collect()
    assert rows(fuse.by_reranker(c.limit(0), strict=True)) == []


def weight(df, n):
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


@pytest.fixture(scope="module")
def statistics(spark):
    """``tide`` is rare in the south and common in the north, ``gull`` is unknown in the south."""
    return {
        "qterms": spark.createDataFrame([("harbour", "tide"), ("harbour", "gull"), ("lantern", "gull")], "query_id string, term string"),
        "df_global": spark.createDataFrame([("tide", 330), ("gull", 40)], "term string, df long"),
        "n_global": spark.createDataFrame([(1500, 80.0)], "n_docs long, avgdl double"),
        "df_local": spark.createDataFrame([("north", "tide", 300), ("south", "tide", 30), ("north", "gull", 40)], "stripe string, term string, df long"),
        "sizes": spark.createDataFrame([("north", 600, 70.0), ("south", 900, 90.0)], "stripe string, n_docs long, avgdl double"),
    }


def test_correction_by_hand(spark, statistics):
    factors = {(q, s): f for q, s, f in rows(fuse.correction(**statistics))}
    g = {"tide": weight(330, 1500), "gull": weight(40, 1500)}
    north = (g["tide"] ** 2 / weight(300, 600) + g["gull"] ** 2 / weight(40, 600)) / (g["tide"] + g["gull"])
    assert factors == {("harbour", "north"): pytest.approx(north), ("harbour", "south"): pytest.approx(g["tide"] / weight(30, 900)), ("lantern", "north"): pytest.approx(g["gull"] / weight(40, 600))}
    c = lists(spark, north=[(1, 3.0)], south=[(2, 3.5)], west=[(3, 3.2)])
    got = {r["doc_id"]: r["fused_score"] for r in fuse.idf_corrected(c, fuse.correction(**statistics)).collect()}
    assert got == {1: pytest.approx(3 * north, abs=1e-8), 2: pytest.approx(3.5 * g["tide"] / weight(30, 900), abs=1e-8), 3: 3.2}
    assert got[1] > got[3] > got[2] and ranked(fuse.naive(c)) == [2, 3, 1]


def test_queries_without_terms_keep_their_scores(spark, statistics):
    c = lists(spark, north=[(1, 3.0)], south=[(2, 3.5)])
    none = statistics | {"qterms": statistics["qterms"].limit(0)}
    assert {r["doc_id"]: r["fused_score"] for r in fuse.idf_corrected(c, fuse.correction(**none)).collect()} == {1: 3.0, 2: 3.5}


POSTINGS = "doc_id long, stripe string, doc_len int, term string, tf long"


def test_local_and_global_statistics_agree_where_they_are_equal(spark, statistics):
    c = lists(spark, north=[(1, 3.0), (4, 2.0)], south=[(2, 3.5), (5, 1.0)])
    near = spark.createDataFrame([(1, "north", 60, "tide", 2), (4, "north", 100, "gull", 1), (2, "south", 90, "tide", 5)], POSTINGS)
    n = statistics["n_global"]
    both = [("north", t, x) for t, x in (("tide", 330), ("gull", 40))] + [("south", t, x) for t, x in (("tide", 330), ("gull", 40))]
    same_df = spark.createDataFrame(both, "stripe string, term string, df long")
    same_size = spark.createDataFrame([("north", 1500, 80.0), ("south", 1500, 80.0)], "stripe string, n_docs long, avgdl double")
    wide = fuse.rescored(c, near, statistics["qterms"], statistics["df_global"], n)
    assert rows(wide) == rows(fuse.rescored(c, near, statistics["qterms"], same_df, same_size, local=True))
    assert rows(wide) != rows(fuse.rescored(c, near, statistics["qterms"], statistics["df_local"], statistics["sizes"], local=True))
    scores = {r["doc_id"]: r["fused_score"] for r in wide.collect()}
    k = 1.2 * (0.25 + 0.75 * 90 / 80)
    assert scores[2] == pytest.approx(weight(330, 1500) * 5 * 2.2 / (5 + k), abs=1e-8) and scores[5] == 0.0


def test_selective_routing(spark, statistics):
    q = spark.createDataFrame([("harbour",), ("lantern",), ("zzz",)], "query_id string")
    y = fuse.yields(statistics["qterms"], statistics["df_global"], statistics["n_global"], statistics["df_local"])
    one = fuse.selected(q, ["north", "south"], y, 1.0)
    assert rows(one) == [("harbour", "north", 1), ("lantern", "north", 1), ("zzz", "north", 2), ("zzz", "south", 2)]
    low = fuse.selected(q, ["north", "south"], y, 0.05)
    assert ("harbour", "south", 2) in rows(low)
    c = lists(spark, north=[(9, 5.0), (3, 5.0), (6, 4.0)], south=[(2, 50.0)])
    empty = spark.createDataFrame([], POSTINGS)
    args = (empty, statistics["qterms"], statistics["df_global"], statistics["n_global"])
    assert ranked(fuse.selective(c, one, *args)) == [9, 3, 6]  # one stripe: its own order, equal scores too


def test_pool_and_external_grades(spark):
    c = lists(spark, north=[(11, 6.0), (12, 5.0)], south=[(12, 60.0), (21, 50.0)])
    assert [r["doc_id"] for r in fuse.pool(c, 3).orderBy("pool_rank").collect()] == [11, 12, 21]
    grades = spark.createDataFrame([("harbour", 21, 2), ("harbour", 12, -1)], "query_id string, doc_id long, grade int")
    assert ranked(fuse.external(c, grades, 10, 3)) == [21, 12, 11]


def test_second_query_of_existing_results(spark):
    c = lists(spark, north=[(i, 99 - i) for i in range(60)])
    scorer = spark.createDataFrame([("harbour", i, float(i)) for i in range(0, 60, 7)], "query_id string, doc_id long, rescore double")
    assert ranked(fuse.reranked_again(c, scorer, 3, depth=50)) == [49, 42, 35]  # the document at place 57 is beyond the fifty keys


def test_a_mean_halfway_between_two_printed_figures_is_rounded_up(spark):
    """20.6671 and 16.7964 have the mean 18.73175, which comes out as 18.731749999999998 in binary."""
    got = fuse.zscore(lists(spark, north=[(11, 20.6671), (12, 16.7964)]), explain=True).orderBy("fused_rank").collect()
    assert [r["explanation"] for r in got] == ["z=(20.6671-18.7318)/1.9354 = 1.0000 in north", "z=(16.7964-18.7318)/1.9354 = -1.0000 in north"]


def test_clean(spark):
    nan = float("nan")
    hit = lambda d, i, s, v=None: ("harbour", "Hybrid", "north", 0, d, i, s, None, v, None)
    c = spark.createDataFrame([hit(1, 2, 5.0), hit(1, 2, 5.0), hit(1, 1, 4.0), hit(2, 3, nan), hit(3, 4, 2.0, nan)], SCHEMA)
    assert rows(fuse.clean(c).select("doc_id", "hit_rank", "score", "vector_similarity")) == [(1, 1, 5.0, None), (3, 4, 2.0, None)]


def test_registry():
    r = Registry(statistics=False)
    assert r.find("GLOBAL-rrf").name == "global-rrf" and r.find("global-bm25") is None
    with pytest.raises(KeyError, match="naive-score"):
        r.get("rrf")
    assert [s.name for s in Registry().only(["interleave"]).supporting("Vector")] == ["interleave"]
    assert all(not s.needs_semantic for s in Registry().supporting("Keyword"))
    assert "agentic-planned" in Registry(planner=True).names()
