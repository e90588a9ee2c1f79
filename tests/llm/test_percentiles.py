import math
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from rankweave.llm import percentiles as P


def frame(spark, data):
    return spark.createDataFrame(data, "g string, day int, v double")


def test_parts_add_up_and_small_groups_are_exact_to_a_step(spark):
    rng = random.Random(1)
    data = [("x", i % 5, rng.lognormvariate(4, 1.5)) for i in range(999)] + [("y", 0, 7.0)] * 3
    data += [("x", 1, None), ("x", 1, float("nan")), ("x", 1, 0.0), ("x", 1, -3.0), ("none", 0, None)]
    days = P.digests(frame(spark, data), ["g", "day"], "v")
    whole = P.with_quantiles(P.merge(days, ["g"]), {"p50": 0.5, "p95": 0.95})
    got = {r["g"]: r for r in whole.collect()}
    assert set(got) == {"x", "y"} and got["x"]["n"] == 999
    xs = sorted(v for g, _, v in data if g == "x" and v is not None and v > 0)
    for q, c in ((0.5, "p50"), (0.95, "p95")):
        assert abs(got["x"][c] / xs[math.ceil(q * len(xs)) - 1] - 1) < 2e-4
    assert abs(got["y"]["p95"] / 7 - 1) < 2e-4
    direct = P.with_quantiles(P.digests(frame(spark, data), ["g"], "v"), {"p50": 0.5, "p95": 0.95})
    assert rows(direct) == rows(whole.select(direct.columns))


def test_compression_keeps_its_rank_error(spark):
    rng = np.random.default_rng(2)
    xs = np.sort(rng.lognormal(3, 2, 60_000))
    data = spark.createDataFrame([("x", int(i % 7), float(v)) for i, v in enumerate(xs)], "g string, day int, v double")
    factor = 512
    merged = P.merge(P.digests(data, ["g", "day"], "v", factor), ["g"], factor)
    r = P.with_quantiles(merged, {"a": 0.5, "b": 0.95, "c": 0.01}).first()
    assert r["n"] == len(xs) and len(merged.first()["nodes"]) <= 3 * factor
    for c, q in (("a", 0.5), ("b", 0.95), ("c", 0.01)):
        rank = np.searchsorted(xs, r[c] * 1.0002)
        # parts and whole are each compressed once
        assert abs(rank - q * len(xs)) <= 2 * P.LEVELS / factor * len(xs) + 2


def test_ends_of_the_universe_and_empty(spark):
    d = frame(spark, [("x", 0, 1e-300), ("x", 0, 1e300), ("x", 0, float("inf"))])
    r = P.with_quantiles(P.digests(d, ["g"], "v"), {"lo": 0.1, "hi": 0.9}).first()
    assert r["lo"] < 1.001 * P.LOW and r["hi"] > 0.99 * P.HIGH
    wide = frame(spark, [("x", 0, v) for v in (3e-25, 7e-9, 2.0, 5e11, 8e27)])
    got = P.with_quantiles(P.digests(wide, ["g"], "v"), {f"q{i}": (i + 0.5) / 5 for i in range(5)}).first()
    assert all(abs(got[f"q{i}"] / v - 1) < 1e-4 for i, v in enumerate((3e-25, 7e-9, 2.0, 5e11, 8e27)))
    assert P.with_quantiles(P.merge(P.digests(d.limit(0), ["g", "day"], "v"), ["g"]), {"p": 0.5}).count() == 0


def test_compressed_digests_of_the_tables_keep_their_rank_error(spark, small):
    """Parts per day and their sums compressed by a small factor: the ranks of the percentiles stay within the bound."""
    factor = 64
    records = P.once(spark.read.parquet(f"{small}/eval_records.parquet"), "record_id", ["mode", "run_day", "latency_ms"], "ingested_at")
    merged = P.merge(P.digests(records, ["mode", "run_day"], "latency_ms", factor), ["mode"], factor)
    got = P.with_quantiles(merged, {"p50": 0.5, "p95": 0.95}).collect()
    held = {r["mode"]: len(r["nodes"]) for r in merged.collect()}
    for r in got:
        xs = np.sort([x[0] for x in records.filter(F.col("mode").eqNullSafe(r["mode"]) & (F.col("latency_ms") > 0) & ~F.isnan("latency_ms")).select("latency_ms").collect()])
        assert r["n"] == len(xs) and held[r["mode"]] < len(np.unique(xs))
        for q, c in ((0.5, "p50"), (0.95, "p95")):
            assert abs(np.searchsorted(xs, r[c] * 1.0002) - q * len(xs)) <= 2 * P.LEVELS / factor * len(xs) + 2


def test_one_delivery_counts_and_published_figures(spark):
    r = spark.createDataFrame([(1, "x", 10.0, 1), (1, "x", 20.0, 2), (2, None, 5.0, 1), (None, "x", 1.0, 1)], "id long, g string, v double, at int")
    once = P.once(r, "id", ["g", "v"], "at")
    assert rows(once) == [("x", 20.0), (None, 5.0)]
    actual = P.with_quantiles(P.digests(once, ["g"], "v"), {"p50": 0.5})
    said = spark.createDataFrame([(1, "x", 20.1), (2, "x", 30.0), (3, None, 9.0), (4, "zz", 1.0), (5, "x", None)], "sid long, g string, f double")
    assert rows(P.off_by(said, actual, ["g"], [("f", "p50")], 0.12).select("sid")) == [(2,), (3,)]
    assert P.off_by(said, actual.filter(F.lit(False)), ["g"], [("f", "p50")], 0.12).count() == 0
