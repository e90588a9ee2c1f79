import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rankweave.llm import mixing
from rankweave.llm import quota_sample as Q

QS = "set_id long, query_id string, text string, shape string, span string, intent string, received_at int"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4).flatmap(lambda r: st.integers(1, 6).flatmap(lambda c: st.lists(st.lists(st.floats(0, 30).map(lambda x: round(x, 4)), min_size=c, max_size=c), min_size=r, max_size=r))))
def test_rounding_keeps_cells_and_margins(table):
    t = np.array(table)
    w = Q.controlled_rounding(t)
    near = lambda whole, real: np.all((whole >= np.floor(np.round(real, 6))) & (whole <= np.ceil(np.round(real, 6))))
    assert near(w, t) and near(w.sum(0), t.sum(0)) and near(w.sum(1), t.sum(1)) and near(w.sum(), t.sum())


def test_labels(spark):
    given_ = {" Torso\t": "Torso", "TORSO": "Torso", "Tosro": "Torso", "1": "Torso", "01": "Torso", "1.0": "Torso", "Torsoo": "Torso", "Tial": "Tail", "Haed": "Head", "Heads": "Head", "0": "Head", "?": None, "n/a": None, "unknown": None, "": None, None: None, "7": None, "-1": None, "Mixed.": None}
    data = [(1, f"q{i}", "t", k, "cross-stripe", "Mixed.", 1) for i, k in enumerate(given_)]
    got = {r["query_id"]: r["shape"] for r in Q.labelled(spark.createDataFrame(data, QS)).collect()}
    assert got == {f"q{i}": v for i, v in enumerate(given_.values()) if v}
    spans = {"Stripe Locale": "StripeLocal", "STRIPE_LOCAL": "StripeLocal", "0": "StripeLocal", "Cross-Strip": "CrossStripe", "1": "CrossStripe", "2": None}
    data = [(1, f"q{i}", "t", "Head", k, "Lexcial", 1) for i, k in enumerate(spans)]
    assert {r["query_id"]: r["span"] for r in Q.labelled(spark.createDataFrame(data, QS)).collect()} == {f"q{i}": v for i, v in enumerate(spans.values()) if v}


def queries(spark):
    data = [(1, f"h{i}", None, "Head", "StripeLocal", "Mixed", 1) for i in range(9)]
    data += [(1, f"t{i}", "x", "tail", "1", "Lexical", 1) for i in range(2)] + [(1, "t0", "x", "Tail", "CrossStripe", "0", 2)]
    data += [(1, "bad", "x", "?", "CrossStripe", "Mixed", 1), (1, "late", "x", "Tail", "?", "Mixed", 1), (1, "late", "x", None, "CrossStripe", "n/a", 5), (None, "n", "x", "Tail", "1", "0", 1), (2, None, "x", "Tail", "1", "0", 1)]
    return spark.createDataFrame(data, QS).withColumn("need", F.lit("clash"))


def targets(spark):
    return spark.createDataFrame(
        [(1, "Head", "StripeLocal", "Mixed", 0.5, 0, 9), (1, "Tail", "CrossStripe", "Lexical", 0.07, 2, 9), (1, "Tail", "CrossStripe", "Mixed", 0.0, 2, 9), (1, "Torso", "CrossStripe", "Mixed", None, None, 9), (2, "Head", "CrossStripe", "Mixed", 0.1, 1, 10), (None, "Head", "CrossStripe", "Mixed", 0.1, 1, 10), (2, "x", "CrossStripe", "Mixed", 0.1, 1, 10)],
        "set_id long, shape string, span string, intent string, target_share double, min_rows int, sample_size int",
    )


def test_plan_and_draw(spark):
    plan = Q.quota_plan(queries(spark), targets(spark))
    got = {(r["set_id"], r["shape"], r["intent"]): (r["need"], r["available"], r["take"], r["short"]) for r in plan.collect()}
    assert got[1, "Head", "Mixed"][:2] == (4.5, 9) and got[1, "Head", "Mixed"][2] in (4, 5)
    assert got[1, "Tail", "Lexical"] == (2.0, 2, 2, False)
    assert got[1, "Tail", "Mixed"] == (2.0, 1, 1, True)  # "late" is pieced together from two deliveries
    assert got[1, "Torso", "Mixed"] == (0.0, 0, 0, False) and got[2, "Head", "Mixed"] == (1.0, 0, 0, True) and len(got) == 5
    drawn = rows(Q.draw(queries(spark), plan))
    assert len(drawn) == sum(v[2] for v in got.values()) and drawn == rows(Q.draw(queries(spark).repartition(5), plan))
    assert Q.quota_plan(queries(spark).limit(0), targets(spark).limit(0)).count() == 0
    assert Q.quota_plan(queries(spark).limit(0), targets(spark)).filter("short").count() == 4


def test_short_cells_follow_the_quotas(spark, monkeypatch):
    """Without the rounding no cell gives all it has, so none is short."""
    assert Q.quota_plan(queries(spark), targets(spark)).filter("short").count() == 2
    monkeypatch.setattr(Q, "quotas", F.pandas_udf(lambda cells: cells.map(lambda g: [0] * len(g)), ArrayType(LongType())))
    assert Q.quota_plan(queries(spark), targets(spark)).filter("short and available > 0").count() == 0


def test_quotas_of_the_tables_keep_their_margins(spark, small):
    plan = Q.quota_plan(spark.read.parquet(f"{small}/eval_queries.parquet"), spark.read.parquet(f"{small}/sample_targets.parquet")).toPandas()
    assert len(plan)
    for keys in (["set_id"], ["set_id", "shape"], ["set_id", "span", "intent"]):
        sums = plan.groupby(keys)[["need", "quota"]].sum().round(6)
        assert ((sums["quota"] >= np.floor(sums["need"])) & (sums["quota"] <= np.ceil(sums["need"]))).all()
    assert ((plan["need"] > plan["available"]) == plan["short"]).all() and (plan["take"] <= plan["available"]).all()


def test_temperature():
    q = np.array([0.7, 0.2, 0.1, 0.0])
    assert mixing.temper(q, 1) == pytest.approx(q) and mixing.temper(q, 0) == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0])
    a = mixing.temper_to_entropy(q, 1.0)
    assert mixing.entropy(mixing.temper(q, a)) == pytest.approx(1.0, abs=1e-9)
    caps = np.array([1.0, 0.3, 0.15, 0.0])
    b = mixing.temper_to_repeats(q, caps)
    assert np.all(mixing.temper(q, b) <= caps + 1e-9) and np.any(mixing.temper(q, b - 0.01) > caps)


DOCS = [(i, "word " * (5 + i % 7), " Big " if i % 2 else "BIG") for i in range(60)] + [(100 + i, "tiny text here", "small-source") for i in range(3)] + [(200, None, "Big"), (201, "", None), (202, "lost words", "  ")]


def test_mix(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("tokens", F.lit(1))
    t = spark.createDataFrame([(1, "big", 0.9, 1, 0.5), (1, "small_source", 0.1, 2, 0.5), (2, "big", 0.5, 4, 2.0), (2, "nowhere", 0.5, 9, 2.0), (3, None, 1.0, 1, 1.0), (4, "big", None, None, None)], "mix_id long, source string, target_share double, max_repeats int, size_factor double")
    laid = mixing.lay_out(docs, t, block_docs=4)
    plan, drawn = laid.plan, mixing.draw(laid)
    p = {(r["mix_id"], r["source"]): r for r in mixing.shares_reached(laid).collect()}
    assert not p[1, "small_source"]["reached"] and p[1, "big"]["reached"] and p[2, "big"]["reached"] and not p[2, "nowhere"]["reached"] and p[4, "big"]["reached"]
    assert set(p) == {(1, "big"), (1, "small_source"), (2, "big"), (2, "nowhere"), (4, "big")}
    assert p[1, "small_source"]["drawn_tokens"] == 2 * p[1, "small_source"]["source_tokens"]
    longest = max(r["tokens"] for r in drawn.collect())
    for r in p.values():
        assert abs(r["drawn_tokens"] - r["budget"]) <= max(longest, 1)
    assert drawn.join(plan, ["mix_id", "source"]).filter("copies > max_repeats").count() == 0
    assert rows(mixing.draw(mixing.lay_out(docs.repartition(6), t, block_docs=4))) == rows(drawn)
    assert plan.first()["mix_tokens"] > 0


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([(1, "big", 1.0, 1, 0.5)], "mix_id long, source string, target_share double, max_repeats int, size_factor double")
    laid = mixing.lay_out(docs, t)
    assert mixing.shares_reached(laid).first()["reached"] and mixing.draw(laid).count() == 0
    assert mixing.mix_plan(mixing.source_sizes(docs), t.limit(0)).count() == 0
