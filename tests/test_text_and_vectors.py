import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.functions import routing, text, vectors
from rankweave.operators import prep
from rankweave.spec import Split


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def out(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_tokens(spark):
    df = col(spark, ["The Dragon's 2nd tale: a x", None, "  !!! ", "über-große İstanbul", "the as that"])
    assert out(df, text.tokenize("x"))[:3] == [["dragon", "2nd", "tale"], [], []]
    assert out(df, text.tokenize("x"))[4] == [] and out(df, text.query_terms("x"))[0] == ["dragon", "2nd", "tale"]


def test_fields(spark):
    df = col(spark, ["en-US", " ", "ger ", None])
    assert out(df, text.normalize_language("x")) == ["en", None, "ger", None]
    df = col(spark, ["1999.0", "-44", "about 1900", "", None])
    assert out(df, text.parse_year("x")) == [1999, -44, None, None, None]
    assert out(df, text.parse_rating("x")) == [1999.0, -44.0, 0.0, 0.0, 0.0]
    assert out(col(spark, ["A B,  C ,,", None]), text.split_authors("x")) == [["A B", "C"], []]
    df = col(spark, ["grade: 2", "7 of 3", "none", "3", None])
    assert out(df, text.parse_grade("x")) == [2, None, None, 3, None]
    df = col(spark, ["q1~d~2", "~d", "q~", "plain"])
    q, d = text.split_custom_id("x")
    assert out(df, q) == ["q1", None, None, None] and out(df, d) == ["d~2", None, None, None]


def test_idf_is_finite_at_the_ends(spark):
    df = col(spark, [0, 5, 10], "int")
    got = out(df, text.idf(F.col("x"), F.lit(10)))
    assert got[0] == pytest.approx(math.log(1 + 10.5 / 0.5)) and got == sorted(got, reverse=True) and got[2] > 0


def test_routing(spark):
    import hashlib

    df = col(spark, [1, 2, 3], "long")
    assert out(df, routing.by_hash("x", 7)) == ["ab"[hashlib.sha256(f"{i}:7".encode()).digest()[0] % 2] for i in (1, 2, 3)]
    years = spark.createDataFrame([(1, 1900), (2, 2000), (3, None)], "id long, y int")
    got = out(years, routing.by_year("y", 1950, "id"))
    assert got[:2] == ["a", "b"] and got[2] == out(col(spark, [3], "long"), routing.by_hash("x"))[0]
    groups = spark.createDataFrame([("Fantasy", "a"), ("fantasy", "b"), ("Crime", "b")], "category string, stripe string")
    docs = spark.createDataFrame([(1, "FANTASY"), (2, "crime"), (3, None), (4, "other")], "id long, g string")
    r = {x["id"]: x["stripe"] for x in routing.by_category(docs, "g", groups, "id").collect()}
    assert r[1] == "a" and r[2] == "b" and {r[3], r[4]} <= {"a", "b"}
    assert routing.with_oracle(docs.withColumn("stripe", F.lit("a"))).count() == 8
    assert [Split("category").name, Split("temporal", cut=1980).name, Split("hash", seed=3).name] == ["category", "temporal-1980", "random-3"]


def test_codec(spark):
    rng = random.Random(5)
    v = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)] + [[0.0] * 64, None]
    df = col(spark, v, "array<float>")
    back = vectors.dequantize(vectors.quantize(F.col("x")))
    rows = df.select("x", back.alias("y"), vectors.cosine(F.col("x"), back).alias("c")).collect()
    for r in rows[:5]:
        step = max(abs(a) for a in r["x"]) / 127
        assert max(abs(a - b) for a, b in zip(r["x"], r["y"])) <= step / 2 + 1e-6 and r["c"] > 0.999
    assert rows[5]["y"] == [0.0] * 64 and rows[5]["c"] is None and rows[6]["y"] is None


def test_prep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, prep.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in prep.pending(old, new, ["k"]).collect()] == [1]
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in prep.stride_sample(rows, ["k"], 7).collect()) == [int(i * 100 / 7) for i in range(7)]
    assert prep.stride_sample(rows, ["k"], 0).count() == 0 and prep.stride_sample(rows, ["k"], 500).count() == 100
    assert sorted(r["k"] for r in prep.stride_sample_int(rows, ["k"], 30).collect()) == list(range(0, 90, 3))
    assert prep.stride_sample(rows.limit(0), ["k"], 5).count() == 0
