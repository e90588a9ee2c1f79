import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.operators import fuse, ranks
from rankweave.plans.inputs import hits


def test_percentiles_match_sorting(spark):
    rng = random.Random(7)
    data = [(rng.choice(["x", "y", None]), rng.choice([None, 0.0, -2.5, 7.0, rng.lognormvariate(3, 2)])) for _ in range(700)] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
    want = {}
    for g in ("x", "y", None):
        s = sorted(v for k, v in data if k == g and v is not None)
        want[g] = tuple(s[max(1, math.ceil(q * len(s))) - 1] for q in (0.5, 0.95, 0.0))
    assert got == want
    assert ranks.percentiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


@pytest.mark.parametrize("heavy", [10**9, 7])
def test_ranks_by_range_match_sorting(spark, heavy):
    """Null groups, and values that many rows share, cut into parts or not."""
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([1.0, 2.0, -0.0, 0.0, rng.random(), -rng.random()])) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    total = {r["i"]: r["r"] for r in ranks.ranked_by_range(df, ["g"], "v", "r", [F.col("i")]).collect()}
    shared = {r["i"]: r["r"] for r in ranks.ranked_by_range(df, ["g"], "v", "r", heavy_rows=heavy).collect()}
    assert len(total) == len(shared) == len(data)
    for g, i, v in data:
        peers = [(w, j) for h, j, w in data if h == g]
        assert total[i] == 1 + sum(w > v or (w == v and j < i) for w, j in peers)
        assert shared[i] == 1 + sum(w > v for w, _ in peers)
    assert ranks.ranked_by_range(df.limit(0), ["g"], "v", "r").count() == 0


def test_a_million_equal_values(spark):
    """A third of all rows share one value of one group: the ranks are right, and no task reads much more than another."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1)).alias("v"), "id")
    total = ranks.ranked_by_range(df, ["g"], "v", "r", [F.col("id")]).filter("g = 'hot'")
    assert total.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first() == (1, 333_334, 333_334)
    assert total.filter(F.col("r") != F.col("id") / 3 + 1).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks are not joined because they are small
    try:
        parts = ranks.ranked_by_range(df, ["g"], "v", "r", [F.col("id")]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts < 0.5 * n
    shared = ranks.ranked_by_range(df, ["g"], "v", "r", heavy_rows=50_000).filter("g = 'hot'")
    assert shared.agg(F.min("r"), F.max("r"), F.count("r")).first() == (1, 1, 333_334)


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [(None,)] * 90, "k string")
    hot = ranks.hot_keys(df, "k", 10)
    assert rows(hot) == [("a",)] and ranks.hot_keys(df, "k", 50) is None
    usual, big = ranks.parted(df, hot, "k")
    assert usual.count() == 93 and big.count() == 50 and usual.filter("k is null").count() == 90


def test_hot_queries_get_the_same_legs(spark, small):
    h = hits(spark, small).filter("mode = 'Hybrid'")
    odd = h.limit(20)
    h = h.unionByName(odd.withColumn("query_id", F.lit(None).cast("string"))).unionByName(odd.withColumn("mode", F.lit(None).cast("string")))
    want = rows(fuse.legs(h, 20))
    assert rows(fuse.legs(h, 20, hot_rows=5)) == want and any(r[0] is None for r in want) and any(r[1] is None for r in want)


def test_value_range_never_falls(spark):
    inf = float("inf")
    xs = sorted([-inf, -1e12, -3.0, -1e-9, 0.0, 1e-9, 0.5, 0.50001, 3.0, 1e300, inf])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ranks.value_range(F.col("x"))).collect()]
    assert got == sorted(got)
