import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.llm import terms

DOCS = [
    (1, "The cat, the CAT and 2 x cats42", "a", 9),
    (2, "the dog", "b", 9),
    (3, None, "a", 9),
    (4, "", None, 9),
    (5, "  \t ", "a", 9),
    (6, "Der Über-Kater　der", None, 9),
    (7, "the dog", "b", 9),
]
SCHEMA = "doc_id long, text string, stripe string, tf long"


def brute(docs):
    df, cf, local = Counter(), Counter(), Counter()
    for _, text, stripe, *_ in docs:
        c = Counter(re.findall(r"[^\W_]{2,}", (text or "").lower()))
        for t, n in c.items():
            df[t] += 1
            cf[t] += n
            local[t, stripe] += 1
    return df, cf, local


@pytest.mark.parametrize("settings", [{}, {"split_rows": 2, "bits": 1}, {"flush_rows": 1, "partitions": 3}])
def test_counts_match_brute_force_however_they_are_split(spark, settings):
    df, cf, local = brute(DOCS)
    # an extra column with the name of a result
    found, records = terms.split(terms.term_statistics(spark.createDataFrame(DOCS, SCHEMA).repartition(3), **settings))
    got = found.collect()
    assert records == {"a": 1, "b": 2, None: 1}
    assert {r["term"]: (r["document_frequency"], r["occurrences"]) for r in got} == {t: (df[t], cf[t]) for t in df}
    assert {(r["term"], s["stripe"]): s["document_frequency"] for r in got for s in r["stripes"]} == dict(local)


def test_marks(spark):
    docs = spark.createDataFrame([(i, "common" + (" mid" if i < 3 else "") + (" rare" if i == 0 else ""), "a") for i in range(8)] + [(9, None, "a")], "doc_id long, text string, stripe string")
    got, records = terms.split(terms.term_statistics(docs))
    assert records == {"a": 8}
    assert rows(terms.marked(got, 8).select("term", "mark")) == [("common", "common"), ("mid", None), ("rare", "rare")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, stripe string, lang string")
    assert terms.term_statistics(empty).count() == 0
    assert rows(terms.most_characteristic(terms.term_weights(empty, empty))) == []
    none = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, stripe string, lang string")
    got, records = terms.split(terms.term_statistics(none))
    assert rows(terms.marked(got, 0)) == [] and records == {}
    assert rows(terms.term_weights(none, none)) == []


def test_weights(spark):
    docs = [(i, "stop word here filler" + (" topic" * 4 if i in (1, 2) else "")) for i in range(12)] + [(50, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    w = {(r["doc_id"], r["term"]): r["weight"] for r in terms.term_weights(d, d, lang=None).collect()}
    residual = -math.log2(2 / 12) + math.log2(1 - math.exp(-8 / 12))
    assert w[1, "topic"] == pytest.approx((1 + math.log(4)) * residual, abs=1e-8)
    assert w[1, "stop"] == pytest.approx(math.log2(1 - math.exp(-1)), abs=1e-8)
    for hot in (0, 1, 4, 10**6):
        assert {(r["doc_id"], r["term"]): r["weight"] for r in terms.term_weights(d, d, lang=None, hot_terms=hot).collect()} == w
    best = dict(rows(terms.most_characteristic(terms.term_weights(d, d.filter("doc_id in (1, 5, 50)"), lang=None))))
    assert best == {1: "topic", 5: "filler"}  # equal weights: the term that sorts first; no words: no term


def bilingual():
    """A large and a small language; the small one's function words are as concentrated as topics, a few labels are wrong or missing."""
    rng = random.Random(3)
    out = []
    for i in range(400):
        small = i % 8 == 0
        words = [rng.choice(["der", "und", "nicht", "ist"] if small else ["the", "and", "not", "is", "was"]) for _ in range(30)]
        words += [f"name{i // 10}"] * 5 if i % 2 else [f"once{i}"] * 2
        out.append((i, " ".join(words), None if i % 31 == 0 else "en" if i % 64 == 0 else "DE " if small else rng.choice(["en-US", "eng", "en"])))
    return out


def test_function_words_of_a_small_language_are_not_characteristic(spark):
    data = bilingual()
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    best = dict(rows(terms.most_characteristic(terms.term_weights(d, d))))
    plain = dict(rows(terms.most_characteristic(terms.term_weights(d, d, lang=None))))
    wrong = lambda got: sum(got[i] in {"der", "und", "nicht", "ist"} for i, _, _ in data)
    assert wrong(best) == 0 < wrong(plain)


def test_languages_come_from_words_before_labels(spark):
    d = spark.createDataFrame(bilingual(), "doc_id long, text string, lang string")
    profile = terms.language_profile(d, "doc_id", "text", "lang")
    assert profile.names == ["de", "en"] and len(profile.words) <= terms.PROFILE_WORDS * 2
    found = pa.table({"d": pa.array([0, 0, 1, 2, 2]), "term": ["der", "und", "zzz", "was", "name1"]})
    assert profile.of(found, 4, pa.array(["en", "fr", None, None])).to_pylist() == ["de", "fr", "en", None]
    _, records = terms.split(terms.term_statistics(d.withColumn("stripe", F.lit(None).cast("string")), profile=profile))
    assert records == {"de": 50, "en": 350}
    assert terms.language_profile(d.limit(0), "doc_id", "text", "lang").words == []


def test_samples_are_the_same_however_they_are_taken(spark):
    from rankweave.llm import common

    df = spark.range(3000).withColumn("x", F.col("id") % 7)
    want = rows(df.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").limit(100))
    assert rows(common.sampled(df, "id", 100)) == rows(common.sampled(df.repartition(5), "id", 100)) == want
    assert common.sampled(df, "id", 5000).count() == 3000 and common.sampled(df.limit(0), "id", 5).count() == 0


def test_long_text(spark):
    d = spark.createDataFrame([(1, "word " * 200_000 + "x" * 300_000, "a")], "doc_id long, text string, stripe string")
    got = {r["term"][:5]: r["occurrences"] for r in terms.term_statistics(d).collect()}
    assert got == {"word": 200_000, "xxxxx": 1, terms.EVERY: 1}
    assert terms.term_counts(d, ["doc_id"]).filter(F.col("tf") == 200_000).count() == 1


def test_every_way_to_split_gives_the_same_statistics_of_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda df: sorted(((r["term"], r["document_frequency"], r["occurrences"], tuple(map(tuple, r["stripes"]))) for r in df.collect()), key=repr)
    want = key(terms.term_statistics(docs))
    assert want == key(terms.term_statistics(docs.repartition(3), split_rows=40, bits=2, flush_rows=200, partitions=2))
    d = docs.select("doc_id", "text", "lang")
    best = rows(terms.most_characteristic(terms.term_weights(d, d)))
    assert best == rows(terms.most_characteristic(terms.term_weights(d, d, hot_terms=100)))


def test_scratch_folders(tmp_path, monkeypatch):
    from rankweave.llm import common

    for name in ("SPARK_LOCAL_DIRS", "LOCAL_DIRS", "SPARK_EXECUTOR_DIRS"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.chdir(tmp_path)
    assert common.scratch_parent(local=False) == str(tmp_path) != common.scratch_parent(local=True)
    (tmp_path / "a").mkdir()
    monkeypatch.setenv("LOCAL_DIRS", f"{tmp_path}/a,{tmp_path}/b")
    assert common.scratch_parent(local=False) == common.scratch_parent(local=True) == f"{tmp_path}/a"
