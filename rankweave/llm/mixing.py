"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Documents of a source that are ordered together when a mix is drawn.
BLOCK_DOCS = 20_000
#: Rows of a plan that are broadcast at once; a longer plan is drawn part by part.
SMALL_PLAN = 50_000
#: Tokens by which a budget and its target may differ through rounding.
ROUNDING = 1e-6


def source_name(label: Column | str) -> Column:
    """The source a label evidently names: lower case, words joined by one underscore; blank gives null."""
    raw = F.col(label) if isinstance(label, str) else label
    name = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{Nd}]+", "_"), r"^_+|_+$", "")
    return F.when(name != "", name)


def bisect(falling, target: float, low: float = 0.0, high: float = 64.0, steps: int = 80) -> float:
    """The argument at which a falling function comes down to ``target``; the nearer end where it never does."""
    if falling(low) <= target:
        return low
    if falling(high) >= target:
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if falling(mid) > target else (low, mid)
    return high


def temper(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised powers of token shares: 1 keeps them, 0 makes them equal. A source without tokens keeps weight 0."""
    q = np.asarray(shares, dtype=float)
    w = np.where(q > 0, np.power(np.where(q > 0, q, 1.0), exponent), 0.0)
    return w / w.sum() if w.sum() > 0 else w


def entropy(w: np.ndarray) -> float:
    p = np.asarray(w, dtype=float)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def temper_to_entropy(shares: np.ndarray, target: float) -> float:
    """The exponent whose tempered shares have the target entropy (nats)."""
    return bisect(lambda a: entropy(temper(shares, a)), target)


def temper_to_repeats(shares: np.ndarray, caps: np.ndarray) -> float:
    """The least exponent from 0 (equal shares) to 1 (natural shares) at which no share exceeds its cap, the share that its repetitions can fill."""
    q, c = np.asarray(shares, dtype=float), np.asarray(caps, dtype=float)
    over = lambda a: float(np.max(np.where(q > 0, temper(q, a) / np.maximum(c, 1e-300), 0.0), initial=0.0))
    return bisect(over, 1.0, high=1.0)


def exponent_of(own: np.ndarray, target: np.ndarray, cap: np.ndarray) -> float:
    """The exponent of a mix: that at which its tempered shares have the entropy of the targets, or a larger one that the repetition limits ask for."""
    if not own.sum():
        return 1.0
    return max(temper_to_entropy(own / own.sum(), entropy(target)), temper_to_repeats(own / own.sum(), cap))


_PLAN = "double, source string, target_share double, max_repeats int, source_tokens long, mix_tokens double, exponent double, tempered_share double, tempered_budget double, target_budget double, budget double"


Exponent = Callable[[np.ndarray, np.ndarray, np.ndarray], float]


def planned(mix: pd.DataFrame, exponent: Exponent = exponent_of) -> pd.DataFrame:
    """The plan of one mix: its tempered weights by ``exponent``, and the budgets."""
    size = float(mix["size_factor"].iloc[0]) * int(mix["total"].iloc[0])
    target = mix["target_share"].to_numpy(dtype=float)
    own = mix["source_tokens"].to_numpy(dtype=float)
    most = own * mix["max_repeats"].to_numpy(dtype=float)
    a = exponent(own, target, most / size if size > 0 else np.zeros(len(mix)))
    share = temper(own, a)
    out = mix[["mix_id", "source", "target_share", "max_repeats", "source_tokens"]].copy()
    out["mix_tokens"], out["exponent"], out["tempered_share"] = size, a, share
    out["tempered_budget"] = np.minimum(share * size, most)
    out["target_budget"], out["budget"] = target * size, np.minimum(target * size, most)
    return out


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """Tokens per source, and in the row whose ``whole`` is 1 of all documents. The corpus is encoded once; the few rows are written to the shared folder."""
    counted = tokens.encode(docs.select(source_name(source).alias("source"), F.col(text).alias("text")), ["source"], "text", ranks, counts_only=True)
    by = counted.rollup("source").agg(F.sum("tokens").alias("source_tokens"), F.grouping("source").alias("whole"))
    return common.durable(by)


def mix_plan(sizes: DataFrame, targets: DataFrame, exponent: Exponent = exponent_of) -> DataFrame:
    """A row per (mix, source): tempered share and budget, target and final budget, in tokens.

    Temperature mixing: the token shares of a mix's sources are raised to one exponent, found by bisection so that the
    normalised powers have the entropy of the targets, or to a larger one where a repetition limit asks for it.
    These weights make the ``tempered_budget`` of each source. One exponent cannot give arbitrary shares, so the
    block permutations are then continued, or stopped earlier, at ``budget``: the target where the repetition
    limit allows it. What a source lacks is not given to others: they keep the shares asked for, and the mix
    ends smaller.

    Null shares, limits and size factors count as 0; rows without mix or source are left out; a source stated
    twice in a mix counts once with its largest share. A source without documents has 0 tokens. The targets do not
    grow with the corpus; each mix is planned in one small task.
    """
    whole = sizes.filter("whole = 1").select(F.coalesce("source_tokens", F.lit(0)).alias("total"))
    own = sizes.filter("whole = 0 and source is not null").select("source", "source_tokens")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    asked = targets.select("mix_id", source_name("source").alias("source"), zero("target_share", "double").alias("target_share"), zero("max_repeats", "int").alias("max_repeats"), zero("size_factor", "double").alias("size_factor"))
    asked = asked.dropna(subset=["mix_id", "source"]).groupBy("mix_id", "source").agg(*[F.max(c).alias(c) for c in ("target_share", "max_repeats", "size_factor")])
    total = whole.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total")).first()["total"]
    joined = asked.join(own, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("total", F.lit(total))
    kind = joined.schema["mix_id"].dataType.simpleString()
    return joined.groupBy("mix_id").applyInPandas(lambda mix: planned(mix, exponent), _PLAN.replace("double", f"mix_id {kind}", 1))


@dataclass
class Laid:
    """The documents of every source laid out in their permutation, the blocks of it, and the plan of the mixes."""

    plan: DataFrame
    #: (source, _block, doc_id, tokens, _at): ``_at`` tokens of the source come before the document.
    placed: DataFrame
    #: (source, _block, _start, _t): the tokens before each block and in it.
    blocks: DataFrame


def lay_out(docs: DataFrame, targets: DataFrame, seed: int = 42, source: str = "source", text: str = "text", ranks: bytes | None = None, block_docs: int = BLOCK_DOCS, exponent: Exponent = exponent_of) -> Laid:
    """Budgeted block permutations, made ready: the documents of a source are permuted by a hash and cut into blocks.

    Token sums per block give each block's place, so a source with a third of all documents is ordered block by block.
    Documents without tokens are never used; null and blank sources belong to no mix.
    """
    counted = tokens.encode(docs.select("doc_id", source_name(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"], "text", ranks, counts_only=True)
    sized = common.durable(counted)
    sizes = common.durable(sized.rollup("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("docs"), F.grouping("source").alias("whole")))
    n = sizes.filter("whole = 1").agg(F.max("docs").alias("n")).first()["n"] or 0
    count = max(16, n // block_docs)
    keyed = sized.filter("tokens > 0 and source is not null").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(count)))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keyed.groupBy("source", "_block").agg(F.sum("tokens").alias("_t")).withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    blocks = common.durable(blocks)
    inside = Window.partitionBy("source", "_block").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(blocks, ["source", "_block"]).select("source", "_block", "doc_id", "tokens", (F.col("_start") + F.sum("tokens").over(inside) - F.col("tokens")).alias("_at"))
    return Laid(common.durable(mix_plan(sizes, targets, exponent)), placed, blocks)


BUDGETS = {"tempered_copies": "tempered_budget", "copies": "budget"}


def _passes(budget: str) -> tuple[Column, Column]:
    """Whole passes of a source that a budget holds, and the tokens left for another."""
    full = F.floor(F.round(F.col(budget) / F.col("source_tokens"), 9))
    return full, F.greatest(F.col(budget) - full * F.col("source_tokens"), F.lit(0.0))


def _used(rest: Column) -> Column:
    """Whether a document is used once more: the one that crosses the end is if at least half of it fits."""
    return F.col("_at") + F.col("tokens") / 2 <= rest


def draw(laid: Laid, small_plan: int = SMALL_PLAN) -> DataFrame:
    """A row (mix, source, doc, tokens, tempered_copies, copies) per document used.

    Documents are used in the order of their permutation until the budget is filled; a budget over the source's size
    takes whole passes first. ``tempered_copies`` realise the tempered weights, ``copies`` the final budget; both
    follow the same permutation, so the smaller draw is a part of the larger. Shares reached are within one document
    of the plan.
    """
    wanted = laid.plan.filter("source_tokens > 0").select("mix_id", "source", "source_tokens", *BUDGETS.values())
    copies = []
    for name, budget in BUDGETS.items():
        full, rest = _passes(budget)
        copies.append((full + _used(rest).cast("long")).alias(name))
    parts = max(1, math.ceil(laid.plan.count() / small_plan))
    drawn = None
    for i in range(parts):
        some = wanted.filter(F.pmod(F.xxhash64("mix_id", "source"), F.lit(parts)) == i) if parts > 1 else wanted
        one = laid.placed.join(F.broadcast(some), "source").select("mix_id", "source", "doc_id", "tokens", *copies)
        drawn = one if drawn is None else drawn.unionByName(one)
    return drawn.filter(" or ".join(f"{c} > 0" for c in BUDGETS))


def drawn_tokens(laid: Laid) -> DataFrame:
    """(mix, source, tempered_tokens, drawn_tokens): the tokens that ``draw`` uses, without a row for each of its documents.

    Of the last pass the blocks before the end of the budget are used whole; only in the one block that the end falls
    into are documents looked at.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), *[c.alias(a) for c, a in zip(_passes(b), ("full", "rest"))]) for n, b in BUDGETS.items()])).alias("k")
    wanted = laid.plan.filter("source_tokens > 0").select("mix_id", "source", "source_tokens", *BUDGETS.values()).select("mix_id", "source", "source_tokens", kinds).select("mix_id", "source", "source_tokens", "k.*")
    ends = F.col("_start") + F.col("_t")
    near = common.durable(wanted.join(laid.blocks, "source").filter(F.col("_start") <= F.col("rest")))
    whole = near.filter(ends <= F.col("rest")).select("mix_id", "source", "kind", F.col("_t").alias("t"))
    crossed = near.filter(ends > F.col("rest")).select("mix_id", "source", "_block", "kind", "rest")
    part = laid.placed.join(crossed, ["source", "_block"]).filter(_used(F.col("rest"))).select("mix_id", "source", "kind", F.col("tokens").alias("t"))
    passes = wanted.select("mix_id", "source", "kind", (F.col("full") * F.col("source_tokens")).alias("t"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("t"))), F.lit(0))
    sums = passes.unionByName(whole).unionByName(part).groupBy("mix_id", "source")
    return sums.agg(total("tempered_copies").alias("tempered_tokens"), total("copies").alias("drawn_tokens"))


def shares_reached(laid: Laid) -> DataFrame:
    """The plan with the tokens drawn for the tempered weights and in the end, the shares of the mix they make, and whether the target was reached.

    A target is not reached where every document was used as often as the limit allows and the tokens still are less.
    """
    both = laid.plan.alias("p").join(drawn_tokens(laid).alias("g"), (F.col("p.mix_id") == F.col("g.mix_id")) & (F.col("p.source") == F.col("g.source")), "left")
    both = both.select("p.*", *[F.coalesce(f"g.{c}", F.lit(0)).alias(c) for c in ("tempered_tokens", "drawn_tokens")])
    share = lambda c: F.when(F.col("mix_tokens") > 0, F.round(F.col(c) / F.col("mix_tokens"), 6))
    used_up = F.col("drawn_tokens") == F.col("source_tokens") * F.col("max_repeats")
    reached = ~(used_up & (F.col("drawn_tokens") + F.lit(ROUNDING) < F.col("target_budget")))
    return both.withColumns({"tempered_actual": share("tempered_tokens"), "actual_share": share("drawn_tokens"), "reached": reached})
