"""Tests of significance against plain-Python versions and tabulated critical values."""

import math
import random
from statistics import fmean, stdev

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.functions import statistics
from rankweave.operators import significance as sig


def diffs(spark, by_strategy):
    data = [("K", s, f"q{i}", float(x)) for s, xs in by_strategy.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(data, "mode string, strategy string, query_id string, d double")


def one(df, strategy):
    return df.filter(F.col("strategy") == strategy).first()


def t_density(t, df):
    return math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + t * t / df) ** (-(df + 1) / 2)


def t_p(t, df, steps=20_000):
    """Two-sided p by the trapezoid rule over the density."""
    xs = np.linspace(0, abs(t), steps)
    return 1 - 2 * np.trapezoid([t_density(x, df) for x in xs], xs)


GAINS = [0.31, -0.12, 0.08, 0.44, 0.27, -0.05, 0.19, 0.36, 0.02, 0.15, -0.21, 0.4]


def test_t_test_matches_integration(spark):
    d = diffs(spark, {"gains": GAINS, "none": [0.0] * 7, "steady": [-0.25] * 9, "lone": [0.7], "pair": [0.5, 0.1]})
    t = sig.paired_t(d)
    for name, xs in (("gains", GAINS), ("pair", [0.5, 0.1])):
        want = fmean(xs) / (stdev(xs) / math.sqrt(len(xs)))
        assert one(t, name)["t"] == pytest.approx(want) and one(t, name)["t_p"] == pytest.approx(t_p(want, len(xs) - 1), abs=1e-6)
    assert tuple(one(t, "none"))[2:] == (0.0, 1.0) == tuple(one(t, "lone"))[2:]
    assert one(t, "steady")["t_p"] == 0.0 and one(t, "steady")["t"] == -math.inf
    s = sig.summary(d)
    assert tuple(one(s, "gains"))[-3:] == (9, 3, 0) and one(s, "none")["ties"] == 7
    e = sig.effect(d)
    assert one(e, "none")["mde"] == 0 and one(e, "gains")["cohens_d"] == pytest.approx(fmean(GAINS) / stdev(GAINS))


# Two-sided critical values of Student's t (t, degrees of freedom, p) as tables print them.
CRITICAL = [(6.314, 1, 0.10), (4.303, 2, 0.05), (4.032, 5, 0.01), (2.131, 15, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05)]


def test_critical_values(spark):
    rows = spark.createDataFrame([(t, n) for t, n, _ in CRITICAL] + [(0.0, 4)], "t double, df int")
    p = [r[0] for r in rows.select(statistics.student_t_p(F.col("t"), F.col("df"))).collect()]
    assert p == pytest.approx([p for *_, p in CRITICAL] + [1.0], abs=2e-4)


def test_normal_functions(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 0.9995]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", statistics.normal_quantile(F.col("p")).alias("z"), statistics.normal_cdf(statistics.normal_quantile(F.col("p"))).alias("back")).collect()
    for r in got:
        assert 0.5 * math.erfc(-r["z"] / math.sqrt(2)) == pytest.approx(r["p"], abs=1e-8) and r["back"] == pytest.approx(r["p"], abs=2e-7)
    assert tuple(spark.range(1).select(*[statistics.normal_quantile(F.lit(x)) for x in (0.0, 1.0, -3.0)]).first()) == (0, 0, 0)


def brute_wilcoxon(xs):
    xs = [x for x in xs if x]
    n = len(xs)
    sizes = sorted(abs(x) for x in xs)
    rank = {a: fmean(i + 1 for i, b in enumerate(sizes) if b == a) for a in sizes}
    w = sum(rank[abs(x)] for x in xs if x > 0)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(c**3 - c for c in (sizes.count(a) for a in set(sizes))) / 48
    if n < 2 or var <= 0:
        return 1.0
    z = max(abs(w - n * (n + 1) / 4) - 0.5, 0) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def test_wilcoxon_matches_brute_force(spark):
    rng = random.Random(5)
    groups = {f"s{i}": [rng.choice([0, 0.1, -0.1, 0.2, round(rng.gauss(0.1, 0.3), 2)]) for _ in range(rng.randint(2, 60))] for i in range(8)} | {"zeros": [0, 0, 0], "lone": [0.4]}
    got = {r["strategy"]: r["w_p"] for r in sig.wilcoxon(diffs(spark, groups)).collect()}
    assert got == {k: pytest.approx(brute_wilcoxon(v), abs=3e-7) for k, v in groups.items()}


def brute_holm(ps):
    out, top = {}, 0.0
    for i, (name, p) in enumerate(sorted(ps.items(), key=lambda x: (x[1], x[0]))):
        top = max(top, min(1.0, (len(ps) - i) * p))
        out[name] = top
    return out


def test_holm_matches_brute_force(spark):
    rng = random.Random(6)
    ps = {f"s{i:02}": round(rng.random() ** 4, 4) for i in range(13)} | {"tie1": 0.013, "tie2": 0.013}
    t = spark.createDataFrame([("K", k, p) for k, p in ps.items()], "mode string, strategy string, p double")
    assert {r["strategy"]: r["p_holm"] for r in sig.holm(t, "p", ["mode"]).collect()} == pytest.approx(brute_holm(ps))


def test_bootstrap_draws_n_of_n(spark):
    """Against the same hash drawn in plain Python."""
    xs = [math.sin(i) for i in range(57)]
    order = sorted((f"q{i}", x) for i, x in enumerate(xs))

    def mixed(x):
        x = ((x ^ x >> 16) * sig.MIX[0]) & 0x7FFFFFFF
        x = ((x ^ x >> 15) * sig.MIX[1]) & 0x7FFFFFFF
        return x ^ x >> 16

    means = []
    for i in range(300):
        start = mixed((i * sig.MIX[2] + sig.SEED) & 0x7FFFFFFF)
        means.append(fmean(order[(mixed((start + j * sig.MIX[1]) & 0x7FFFFFFF) * 57) >> 31][1] for j in range(57)))
    got = sig.bootstrap_ci(diffs(spark, {"x": xs, "flat": [0.3] * 20}), 300)
    assert (one(got, "x")["ci_low"], one(got, "x")["ci_high"]) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))
    assert one(got, "flat")["ci_low"] == pytest.approx(0.3) == one(got, "flat")["ci_high"]


def test_bootstrap_of_groups_in_blocks(spark):
    """Blocks draw n of n together, and give the interval of the normal approximation."""
    sizes = np.array([40, 3, 57, 1, 99])
    parts = [sig.shared_out(sizes, b, 500, 1) for b in range(5)]
    assert (sum(parts) == 200).all() and abs(parts[0].mean() - 40) < 1.5
    rng = random.Random(9)
    xs = [rng.gauss(0.2, 1.0) for _ in range(400)]
    d = diffs(spark, {"x": xs})
    whole, cut = (one(sig.bootstrap_ci(d.repartition(p), 1000, block_rows=b), "x") for p, b in ((1, 65_536), (5, 50)))
    gap = 1.96 * stdev(xs) / 20
    for r in (whole, cut):
        assert r["ci_low"] == pytest.approx(fmean(xs) - gap, abs=0.02) and r["ci_high"] == pytest.approx(fmean(xs) + gap, abs=0.02)
    assert sig.bootstrap_ci(d.limit(0), 10).count() == 0


def test_first_record_of_a_query_wins(spark):
    r = spark.createDataFrame([("K", "s", "q", 2, 0.9), ("K", "s", "q", 1, 0.4), ("K", "b", "q", 3, 0.1), ("K", "s", "x", 4, None)], "mode string, strategy string, query_id string, id int, v double")
    d = sig.differences(sig.first_per_query(r, "v", "id"), "b").collect()
    assert [x["d"] for x in d] == [pytest.approx(0.3)]


def brute_kappa(pairs):
    n = len(pairs)
    w = lambda i, j: (i - j) ** 2 / 9
    seen = sum(w(a, b) for a, b in pairs) / n
    chance = sum(w(a, b) for a, _ in pairs for _, b in pairs) / n / n
    return 1 - seen / chance if chance > 0 else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=30))
def test_kappa_and_agreement(spark, pairs):
    df = spark.createDataFrame(pairs, "g1 int, g2 int")
    assert sig.kappa(df).first()[0] == pytest.approx(brute_kappa(pairs))
    a = sig.agreement(df).first()
    assert a["exact"] == pytest.approx(sum(x == y for x, y in pairs) / len(pairs))
