"""Keyword lists are added up in blocks of queries and documents; sums of matching pairs are never rows."""

import math
import random
import re

import pytest

from rankweave.operators import retrieve
from rankweave.plans import registry

QUERIES = {"p": ["w0"], "q": ["w0", "w1"], "r": ["w1", "w0"], "s": ["w2", "w3", "w4"], "t": ["none"], "u": ["w5", "none", "w6"], "v": [f"w{i}" for i in range(12)]}


@pytest.fixture(scope="module")
def postings(spark):
    """Terms of growing frequency, many equal documents, and a document that only one stripe has."""
    rng, rows = random.Random(5), []
    for doc in range(300):
        tf = {f"w{i}": rng.choice([1, 1, 2]) for i in range(12) if rng.random() < (i + 1) / 14}
        rows += [(doc, "a" if doc % 3 else "b", 20 + doc % 2, t, n) for t, n in tf.items()]
    return rows


def _expected(rows, top):
    stripes, out = {"a": (200, 20.5), "b": (100, 20.5)}, {}
    df, wide = {}, {}
    for _, s, _, t, _ in rows:
        df[s, t] = df.get((s, t), 0) + 1
        wide[t] = wide.get(t, 0) + 1
    weight = lambda f, n, tf, dl, avg: math.log(1 + (n - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    for q, terms in QUERIES.items():
        hits = {}
        for d, s, dl, t, tf in rows:
            if t in terms:
                score, held, whole, _ = hits.get((s, d), (0.0, 0, 0.0, dl))
                hits[s, d] = score + weight(df[s, t], stripes[s][0], tf, dl, stripes[s][1]), held + 1, whole + weight(wide[t], 300, tf, dl, 20.5), dl
        for stripe in stripes:
            best = sorted((-round(x[0], 9), d, x) for (s, d), x in hits.items() if s == stripe)[:top]
            for i, (score, d, x) in enumerate(best):
                out[q, stripe, i + 1] = (d, x[3], round(-score, 6), x[1], round(x[2], 6), len(terms))
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2}, {"corpus_block": 40}, {"query_block": 3, "corpus_block": 70}])
def test_lists_are_those_of_all_pairs_whatever_the_blocks(spark, postings, blocks):
    near = spark.createDataFrame(postings, "doc_id long, stripe string, doc_len int, term string, tf long")
    qterms = spark.createDataFrame([(q, t) for q, ts in QUERIES.items() for t in ts], "query_id string, term string")
    df = retrieve.probe(near)
    size = spark.createDataFrame([("a", 200, 20.5), ("b", 100, 20.5)], "stripe string, n_docs long, avgdl double")
    whole = df.groupBy("term").agg({"df": "sum"}).withColumnRenamed("sum(df)", "df"), spark.createDataFrame([(300, 20.5)], "n_docs long, avgdl double")
    for top in (1, 7, 500):
        found = retrieve.opened(retrieve.lists(near, qterms, df, size, whole, top, **blocks))
        got = {(r["query_id"], r["stripe"], r["hit_rank"]): (r["doc_id"], r["doc_len"], round(r["score"], 6), r["held"], round(r["whole"], 6), r["need"]) for r in found.collect()}
        assert got == _expected(postings, top)
    assert retrieve.lists(near.limit(0), qterms, df.limit(0), size.limit(0), whole).isEmpty() and retrieve.lists(near, qterms.limit(0), df, size, whole).isEmpty()


def _plan(spark, small, name):
    return registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


# Shuffles of the plan over the lists, which are cut by query; those that remain are of terms, of factors and of (query, document).
MOST = {"eval_agentic_rerank": 0, "eval_evaluate_matrix": 40, "eval_external_rerank": 3, "eval_global_bm25": 0, "eval_merge_bm25": 11, "eval_agentic_cheap": 4, "eval_candidate_budget": 0, "eval_explain_query": 0, "eval_fan_out": 0, "eval_idf_correct_probe": 8, "eval_keyword_topk": 0, "eval_agentic_planned": 11, "eval_explain_search": 11, "eval_idf_correct_sidecar": 7, "eval_local_bm25": 0}


@pytest.mark.parametrize("name", MOST)
def test_what_is_ranked_per_query_is_not_shuffled_again(spark, small, name):
    assert len(re.findall(r"Exchange", _plan(spark, small, name))) <= MOST[name]


@pytest.mark.parametrize("name", ["eval_filtered_retrieval", "eval_merge_bm25", "eval_agentic_planned"])
def test_pairs_are_added_up_in_blocks(spark, small, name):
    plan = _plan(spark, small, name)
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"Join \[query_id|HashAggregate\(keys=\[query_id#\d+, stripe#\d+, doc_id", plan)
