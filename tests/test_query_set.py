"""The searches over the evaluation queries."""

import duckdb
import pytest
from conftest import rows

from rankweave.operators import retrieve
from rankweave.plans import registry
from rankweave.plans.inputs import halves, index_of, retrieved


def test_every_evaluation_query_is_searched(spark, small):
    ids = {r[0] for r in duckdb.execute(f"SELECT DISTINCT query_id FROM '{small}/eval_queries.parquet' WHERE query_id IS NOT NULL").fetchall()}
    got = retrieved(spark, small, everything=True).queries.collect()
    assert len(got) == len(ids) and {x["query_id"] for x in got} == ids
    assert any(x["text"] is None for x in got)
    stated = {x["query_id"] for x in retrieved(spark, small).queries.collect()}
    assert stated == {i for i in ids if int(i[1:]) % 50 == 0} != set()


def test_every_query_with_a_known_term_has_a_list(spark, small):
    r = retrieved(spark, small, everything=True)
    known = r.qterms.join(registry.queries()["df_global"](spark, small), "term", "left_semi").select("query_id").distinct()
    lists = registry.queries()["eval_global_bm25"](spark, small).select("query_id").distinct()
    assert known.count() == lists.count() > 100
    assert known.join(lists, "query_id", "left_anti").isEmpty()


def test_both_joins_of_the_vocabulary_give_the_same_postings(spark, small, monkeypatch):
    r = retrieved(spark, small)
    few = rows(retrieve.matching(r.index.postings, r.qterms))
    monkeypatch.setattr(retrieve, "FEW_TERMS", 1)
    assert rows(retrieve.matching(r.index.postings, r.qterms)) == few != []


def test_postings_hold_every_document_once_without_a_term(spark, small):
    index = index_of(spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert index.lengths.count() == index.lengths.select("doc_id").distinct().count() == n
    sums = index.postings.filter("term <> ''").groupBy("doc_id").agg({"tf": "sum"}).join(index.lengths, "doc_id")
    assert sums.filter("`sum(tf)` <> doc_len").isEmpty()


def test_the_index_is_kept_until_a_table_or_the_folder_changes(spark, small, tmp_path):
    import shutil

    from rankweave.session import shared_folder

    for t in ("documents", "books"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    d = str(tmp_path)
    first = index_of(spark, d)
    assert index_of(spark, d) is first and index_of(spark, d, stop=False) is not first
    later = spark.read.parquet(f"{d}/documents.parquet").limit(7)
    later.coalesce(1).write.parquet(f"{d}/new")
    shutil.rmtree(f"{d}/documents.parquet", ignore_errors=True)
    (tmp_path / "documents.parquet").unlink(missing_ok=True)
    shutil.move(f"{d}/new", f"{d}/documents.parquet")
    second = index_of(spark, d)
    assert second is not first and second.lengths.count() == 7
    folder = shared_folder(spark).removeprefix("file:")
    for name in __import__("os").listdir(folder):
        if name.startswith("kept-"):
            __import__("os").remove(f"{folder}/{name}")
    assert index_of(spark, d) is not second


def test_stand_in_planner(spark):
    q = spark.createDataFrame([("a", "red fox over hills"), ("b", "wizard"), ("c", None), ("d", "one two three")], "query_id string, text string")
    assert rows(halves(q)) == sorted([("a", "a.1", "red fox"), ("a", "a.2", "over hills"), ("b", "b.1", "wizard"), ("c", "c.1", None), ("d", "d.1", "one two"), ("d", "d.2", "three")], key=repr)


VECTORS = [(i, "ab"[i % 2], [float((i * k) % 7 - 3) for k in (1, 2, 3)]) for i in range(60)] + [(90, "a", [0.0, 0.0, 0.0]), (91, "b", None), (92, None, [1.0, 1.0, 1.0])]


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "corpus_block": 7}])
def test_vector_search_matches_brute_force(spark, blocks, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "CELLS", 64)
    corpus = spark.createDataFrame(VECTORS, "doc_id long, stripe string, embedding array<float>")
    asked = [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, 0.0, 1.0]), (4, [1.0, 1.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    got = {(r["query_id"], r["stripe"], r["hit_rank"]): (r["doc_id"], r["score"]) for r in retrieve.vector(corpus, queries, 5, ["a", "b"], **blocks).collect()}
    want = {}
    for q, v in asked:
        for stripe in ("a", "b", None):
            own = [(d, e) for d, s, e in VECTORS if s == stripe and e and any(e)]
            if any(v):
                scored = sorted((-round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 9) + 0.0, d) for d, e in own)
                want |= {(q, stripe, i): (d, -s) for i, (s, d) in enumerate(scored[:5], start=1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    with pytest.raises(ValueError):
        retrieve.vector(corpus, queries.selectExpr("query_id", "null as embedding").selectExpr("query_id", "cast(embedding as array<float>) embedding"))
    assert retrieve.vector(corpus, queries.limit(0)).count() == retrieve.vector(corpus.limit(0), queries).count() == 0


def test_a_failed_stripe_costs_its_own_hits_only(spark, tmp_path):
    good = spark.createDataFrame([(1, "a")], "doc_id int, stripe string")
    hits, failures = retrieve.answered({"a": lambda: good, "b": lambda: spark.read.parquet(str(tmp_path / "missing"))})
    assert rows(hits) == [(1, "a")] and list(failures) == ["b"]
    with pytest.raises(RuntimeError, match="no stripe answered"):
        retrieve.answered({"b": lambda: spark.read.parquet(str(tmp_path / "missing"))})
    with pytest.raises(RuntimeError):
        retrieve.answered({})
