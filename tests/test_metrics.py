import random

import pytest

from rankweave.operators import metrics


def lists(spark, by_query):
    data = [(q, d, i + 1) for q, ds in by_query.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(data, "query_id string, doc_id string, rank int")


def values(df, name):
    return {r["query_id"]: r[name] for r in df.collect()}


TRUTH = {q: list("abcde") for q in ("same", "apart", "top", "tail", "recall", "reverse", "empty")}
GOT = {"same": list("abcde"), "apart": list("vwxyz"), "top": list("bacde"), "tail": list("abced"), "recall": list("abcxy"), "reverse": list("edcba")}


@pytest.fixture(scope="module")
def three(spark):
    q = spark.createDataFrame([(x,) for x in [*TRUTH, "nothing"]], "query_id string")
    return q, lists(spark, GOT), lists(spark, TRUTH)


def test_fidelity(three):
    v = values(metrics.ndcg(*three, 5), "ndcg")
    assert v["same"] == pytest.approx(1) and v["apart"] == v["empty"] == v["nothing"] == 0
    assert v["top"] < v["tail"] < 1


def test_overlap(three):
    m = metrics.overlap(*three, 5)
    assert values(m, "recall") | {} == {**values(m, "recall"), "recall": 0.6, "empty": 0.0, "nothing": 0.0}
    assert values(m, "jaccard")["nothing"] == 1.0 and values(m, "jaccard")["empty"] == 0.0


def test_tau(three):
    v = values(metrics.kendall(*three), "kendall_tau")
    assert (v["same"], v["reverse"], v["top"], v["apart"]) == (1.0, -1.0, 0.8, 0.0)


def test_rbo_against_its_definition(spark, three):
    v = values(metrics.rbo(*three, 5), "rbo")
    assert v["same"] == pytest.approx(1) and v["apart"] == v["empty"] == 0 and v["nothing"] == 1
    with pytest.raises(ValueError):
        metrics.rbo(*three, 5, 1.0)
    rng = random.Random(3)
    a = {f"q{i}": rng.sample("abcdefghij", rng.randint(1, 8)) for i in range(40)}
    b = {f"q{i}": rng.sample("abcdefghij", rng.randint(1, 8)) for i in range(40)}
    q = spark.createDataFrame([(x,) for x in a], "query_id string")
    got = values(metrics.rbo(q, lists(spark, a), lists(spark, b), 6), "rbo")
    for x in a:
        p, depth = 0.9, max(len(a[x][:6]), len(b[x][:6]))
        total = sum(p ** (d - 1) * len(set(a[x][:6][:d]) & set(b[x][:6][:d])) / d for d in range(1, depth + 1))
        assert got[x] == pytest.approx((1 - p) * total / (1 - p**depth), abs=1e-12)


def test_judged(spark):
    j = spark.createDataFrame([("q", "e", 3), ("q", "g", 2), ("q", "m", 1), ("q", "i", 0)], "query_id string, doc_id string, grade int")
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    v = lambda ds: values(metrics.judged_ndcg(q, lists(spark, {"q": ds, "none": ["e"]}), j, 10), "judged_ndcg")
    assert v(list("egmi"))["q"] == pytest.approx(1) and v(list("egmi"))["none"] == 0
    assert v(["i", "unjudged"])["q"] == 0
    assert v(["e", "unjudged"])["q"] == v(["e", "i"])["q"]
    c = metrics.coverage(q, lists(spark, {"q": ["e", "x", "g", "y"]}), j, 10)
    assert values(c, "judged_coverage") == {"q": 0.5, "none": 0.0}


def test_mix_and_identity(spark):
    li = spark.createDataFrame([("q", "d1", 1, "b"), ("q", "d2", 2, "b"), ("q", "d3", 3, "a")], "query_id string, doc_id string, rank int, stripe string")
    assert metrics.stripe_mix(li).first()["stripe_mix"] == "a=1 | b=2"
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert values(metrics.identical(q, li, li.filter("rank < 3"), 2), "same") == {"q": 1, "none": 1}
