"""The bisected exponent of a mix decides what is drawn for its tempered weights; reaching a target follows from the draw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave.llm import mixing, tokens


def _mix(**more):
    return pd.DataFrame({"mix_id": [1, 1, 1], "source": ["a", "b", "c"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [9, 9, 9], "size_factor": [1.0] * 3, "source_tokens": [300, 100, 200], "total": [1000] * 3}).assign(**more)


def test_weights_have_the_entropy_of_the_targets():
    got = mixing.planned(_mix())
    w = got["tempered_share"].to_numpy()
    assert w.sum() == pytest.approx(1) and mixing.entropy(w) == pytest.approx(mixing.entropy(np.array([0.5, 0.3, 0.2])), abs=1e-9)
    assert w == pytest.approx(mixing.temper(np.array([300, 100, 200]) / 600, got["exponent"][0]))
    assert list(got["tempered_budget"]) == pytest.approx(list(1000 * w))


def test_weights_keep_the_repetition_limit():
    got = mixing.planned(_mix(target_share=[0.34, 0.33, 0.33], max_repeats=[9, 2, 9]))
    assert got["exponent"][0] > mixing.temper_to_entropy(np.array([0.5, 1 / 6, 1 / 3]), mixing.entropy(np.array([0.34, 0.33, 0.33])))
    assert got["tempered_share"][1] == pytest.approx(0.2) and got["tempered_budget"].sum() == pytest.approx(1000)


def test_an_empty_mix_is_planned():
    got = mixing.planned(_mix(size_factor=0.0))
    assert list(got["budget"]) == list(got["target_budget"]) == [0.0] * 3


@pytest.fixture(scope="module")
def tables(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/mix_targets.parquet")


def test_the_draw_follows_the_exponent(spark, tables):
    """Drawn with another exponent the tempered part changes; a plan that ignored the exponent would not show it."""
    mixes = tables[1].filter("mix_id <= 3")
    drawn = lambda **how: {(r["mix_id"], r["source"]): (r["tempered_tokens"], r["drawn_tokens"]) for r in mixing.shares_reached(mixing.lay_out(tables[0], mixes, **how)).collect()}
    before, after = drawn(), drawn(exponent=lambda own, target, cap: 0.0)
    assert any(before[k][0] != after[k][0] for k in before) and all(before[k][1] == after[k][1] for k in before)


def brute(docs, targets):
    """Sums of tokens by source, and by plain arithmetic which targets are out of reach."""
    enc = tokens.encoder(tokens.rank_file())
    own, total = {}, 0
    for text, source in docs:
        n = len(tokens.encode_text(enc, text))
        total += n
        own[source] = own.get(source, 0) + n
    return {(m, s) for m, s, share, repeats, factor in targets if share * factor * total > own.get(s, 0) * repeats + 1e-6}, own, total


@pytest.mark.parametrize("small_plan", [mixing.SMALL_PLAN, 40])
def test_unreached_targets_are_those_that_arithmetic_says(spark, tables, small_plan):
    docs, targets = tables
    named = [(r[0], r[1]) for r in docs.select("text", mixing.source_name("source")).collect()]
    asked = [tuple(r) for r in targets.select("mix_id", mixing.source_name("source"), "target_share", "max_repeats", "size_factor").collect()]
    laid = mixing.lay_out(docs, targets, block_docs=10)
    plan, drawn = laid.plan, mixing.draw(laid, small_plan)
    reached = mixing.shares_reached(laid)
    rows_ = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("tempered_copies")).alias("a"), F.sum(F.col("tokens") * F.col("copies")).alias("b"))
    sums = {(r["mix_id"], r["source"]): (r["a"], r["b"]) for r in rows_.collect()}
    want, own, total = brute(named, asked)
    got = {(r["mix_id"], r["source"]) for r in reached.filter("not reached").collect()}
    assert got == want != set()
    longest = max(1, drawn.agg(F.max("tokens")).first()[0])
    for r in reached.collect():
        assert r["source_tokens"] == own.get(r["source"], 0) and r["mix_tokens"] == pytest.approx(total * next(x[4] for x in asked if x[0] == r["mix_id"]))
        assert (r["tempered_tokens"], r["drawn_tokens"]) == sums.get((r["mix_id"], r["source"]), (0, 0))
        assert abs(r["drawn_tokens"] - r["budget"]) <= longest and abs(r["tempered_tokens"] - r["tempered_budget"]) <= longest
        assert r["reached"] is False or r["drawn_tokens"] >= r["target_budget"] - longest
    over = drawn.join(plan, ["mix_id", "source"]).filter("copies > max_repeats or tempered_copies > max_repeats")
    assert over.isEmpty()
