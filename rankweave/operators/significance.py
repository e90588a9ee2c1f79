"""Paired significance tests, grouped by mode and strategy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import normal_cdf, normal_quantile, student_t_p
from ..session import durable
from .ranks import summed_by_range

ITERATIONS, SEED = 10_000, 20260904
#: Pairs of a group that are resampled in one task.
BLOCK_ROWS = 65_536
GROUP = ["mode", "strategy"]


def first_per_query(records: DataFrame, value: str, order: str) -> DataFrame:
    """(mode, strategy, query_id, value): of several rows of a query the first; rows without a value are dropped."""
    ok = records.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*GROUP, "query_id").agg(F.min_by(value, order).alias("value"))


def differences(values: DataFrame, baseline: str) -> DataFrame:
    """(mode, strategy, query_id, d): every strategy's value less the baseline's, over the queries both have."""
    base = values.filter(F.col("strategy") == baseline).select("mode", "query_id", F.col("value").alias("_b"))
    return values.filter(F.col("strategy") != baseline).join(base, ["mode", "query_id"]).select(*GROUP, "query_id", (F.col("value") - F.col("_b")).alias("d"))


def summary(d: DataFrame) -> DataFrame:
    """n, mean, wins, losses and ties."""
    return d.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("d").alias("mean"),
        F.sum((F.col("d") > 0).cast("long")).alias("wins"),
        F.sum((F.col("d") < 0).cast("long")).alias("losses"),
        F.sum((F.col("d") == 0).cast("long")).alias("ties"),
    )


def paired_t(d: DataFrame) -> DataFrame:
    """t and its two-sided p. Without spread: (0, 1) for a zero mean, else (infinity, 0). Fewer than two pairs: (0, 1)."""
    s = d.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), (F.max("d") - F.min("d")).alias("w"))
    flat = F.col("w") == 0
    t = F.when(F.col("n") < 2, 0.0).when(flat & (F.col("m") == 0), 0.0).when(flat, F.lit(float("inf")) * F.signum("m")).otherwise(F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double"))))
    with_t = s.select(*GROUP, "n", t.alias("t"))
    return with_t.select(*GROUP, "t", F.when(F.col("n") < 2, 1.0).otherwise(student_t_p(F.col("t"), F.col("n") - 1)).alias("t_p"))


def wilcoxon(d: DataFrame) -> DataFrame:
    """Signed-rank p by the normal approximation with midranks, tie and continuity corrections; zeros are dropped.

    Midranks come from the counts of equal sizes, which are added up range by range, so that no group's sizes are
    ordered in one task. Fewer than two differences or no variance give 1.
    """
    z = d.filter("d <> 0").withColumn("a", F.round(F.abs("d"), 12))
    peers = z.groupBy(*GROUP, "a").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    placed = summed_by_range(peers, GROUP, [F.col("a")], F.col("c"), "_before")
    mid = placed.withColumn("r", F.col("_before") + (F.col("c") + 1) / 2.0)
    c = F.col("c").cast("double")
    s = mid.groupBy(*GROUP).agg(F.sum("c").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w"), F.sum(c * (c * c - 1) / 48.0).alias("tie"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie")
    gap = F.greatest(F.abs(F.col("w") - n * (n + 1) / 4.0) - 0.5, F.lit(0.0))
    p = F.when((F.col("n") < 2) | (var <= 0), 1.0).otherwise(F.least(F.lit(1.0), 2.0 * (1.0 - normal_cdf(gap / F.sqrt(var)))))
    got = s.select(*GROUP, p.alias("w_p"))
    return d.select(*GROUP).distinct().join(got, GROUP, "left").fillna({"w_p": 1.0})


def effect(d: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Cohen's d, standard deviation of the differences, and the smallest difference that the sample could detect."""
    s = d.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), (F.max("d") - F.min("d")).alias("w"))
    ok = (F.col("n") >= 2) & (F.col("w") > 0)
    z = normal_quantile(F.lit(1 - alpha / 2)) + normal_quantile(F.lit(power))
    return s.select(
        *GROUP,
        F.when(ok, F.col("m") / F.col("s")).otherwise(0.0).alias("cohens_d"),
        F.when(ok, F.col("s")).otherwise(0.0).alias("diff_sd"),
        F.when(ok, z * F.col("s") / F.sqrt(F.col("n").cast("double"))).otherwise(0.0).alias("mde"),
    )


def holm(tests: DataFrame, p: str, within: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down correction of the p values of one family (a mode's strategies: a few rows)."""
    order = Window.partitionBy(*within).orderBy(p, *[c for c in ("strategy",) if c in tests.columns])
    m = F.count(F.lit(1)).over(Window.partitionBy(*within))
    stepped = tests.withColumn("_q", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return stepped.withColumn(out, F.max("_q").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_q")


# The multipliers of the hash that draws.
MIX = (73244475, 48271, 40503)
_LOW = (1 << 31) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = ((x ^ (x >> 16)) * MIX[0]) & _LOW
    x = ((x ^ (x >> 15)) * MIX[1]) & _LOW
    return x ^ (x >> 16)


def drawn(iterations: np.ndarray, draws: np.ndarray, n: int, seed: int, block: int = 0) -> np.ndarray:
    """The places from 0 to n - 1 that the draws of the iterations fall on (a row each iteration): a hash of both, the same for equal n."""
    start = _mixed((iterations.astype(np.int64) * MIX[2] + seed + block) & _LOW)
    return (_mixed((start[:, None] + draws.astype(np.int64)[None, :] * MIX[1]) & _LOW) * n) >> 31


def shared_out(sizes: np.ndarray, block: int, iterations: int, seed: int) -> np.ndarray:
    """How many of n draws fall into a block of a group of n pairs, for each iteration.

    The draws are divided between the halves of the blocks, and again, by binomial numbers seeded with the halves:
    every block finds its own number alone, and the numbers of all blocks add up to n.
    """
    low, high = 0, len(sizes)
    left = np.full(iterations, int(sizes.sum()), dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        share = sizes[low:mid].sum() / sizes[low:high].sum()
        first = np.random.default_rng([seed, low, high]).binomial(left, share)
        if block < mid:
            high, left = mid, first
        else:
            low, left = mid, left - first
    return left


def _block_sums(iterations: int, seed: int):
    """Bootstrap sums of one block of a group's pairs, an Arrow batch of iterations at a time."""

    def run(part: pa.Table) -> pa.Table:
        order = pc.sort_indices(part, sort_keys=[("query_id", "ascending"), ("d", "ascending")])
        d = np.asarray(part["d"].take(order))
        block, sizes = part["_block"][0].as_py(), np.array(part["_sizes"][0].as_py(), dtype=np.int64)
        times = shared_out(sizes, block, iterations, seed)
        sums = np.zeros(iterations)
        step = max(1, 2_000_000 // max(1, int(times.max(initial=1))))
        for i in range(0, iterations, step):
            at = np.arange(i, min(i + step, iterations))
            draws = np.arange(int(times[at].max(initial=0)))
            taken = d[drawn(at, draws, len(d), seed, block)]
            sums[at] = taken.sum(axis=1) if (times[at] == len(draws)).all() else np.where(draws[None, :] < times[at][:, None], taken, 0.0).sum(axis=1)
        key = {g: pa.array([part[g][0].as_py()] * iterations, pa.string()) for g in GROUP}
        return pa.table({**key, "i": pa.array(np.arange(iterations, dtype=np.int32)), "s": pa.array(sums)})

    return run


def bootstrap_ci(d: DataFrame, iterations: int = ITERATIONS, seed: int = SEED, level: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Percentile interval of the mean by resampling n of n pairs, linearly interpolated: (mode, strategy, ci_low, ci_high).

    Every draw is a hash of its iteration and number, so groups of equal size see the same draws and a run can be
    repeated. A group of more than ``block_rows`` pairs is cut into blocks; the number of draws that fall into each
    is binomial, so that together they are n again, and no task holds more than about a block. Pairs with a null key
    or difference are left out; an empty table gives no rows.
    """
    ok = d.dropna(subset=[*GROUP, "query_id", "d"]).select(*GROUP, F.col("query_id").cast("string").alias("query_id"), F.col("d").cast("double").alias("d"))
    n = ok.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    cut = ok.join(n, GROUP).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / F.lit(block_rows))).cast("int"))
    held = cut.groupBy(*GROUP, "_block").agg(F.count(F.lit(1)).alias("_c"))
    # the blocks that hold pairs are numbered in order; a group has one for each block_rows of its pairs
    shape = held.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("_block", "_c"))).alias("_s"))
    shape = shape.select(*GROUP, F.transform("_s", lambda x: x["_c"]).alias("_sizes"), F.transform("_s", lambda x: x["_block"]).alias("_names"))
    rows = cut.join(shape, GROUP).select(*GROUP, "query_id", "d", (F.array_position("_names", F.col("_block")) - 1).cast("int").alias("_block"), "_sizes")
    sums = rows.groupBy(*GROUP, "_block").applyInArrow(_block_sums(iterations, seed), "mode string, strategy string, i int, s double")
    means = sums.groupBy(*GROUP, "i").agg(F.sum("s").alias("s")).join(n, GROUP).withColumn("m", F.col("s") / F.col("_n"))
    tail = (1 - level) / 2
    return means.groupBy(*GROUP).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))


def table(records: DataFrame, value: str, order: str, baseline: str, within: str = "mode") -> DataFrame:
    """Every strategy against the baseline: counts, mean with its interval, t, Wilcoxon, effect and Holm-corrected p within a mode."""
    d = durable(differences(first_per_query(records, value, order), baseline))
    out = summary(d).join(bootstrap_ci(d), GROUP).join(paired_t(d), GROUP).join(wilcoxon(d), GROUP).join(effect(d), GROUP)
    return holm(out, "t_p", [within])


def kappa(pairs: DataFrame) -> DataFrame:
    """Quadratically weighted kappa of two judges on grades 0 to 3 (columns g1, g2); 0 where chance leaves no disagreement."""
    cells = pairs.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c"))
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)])
    n = cells.agg(
        F.sum("c").alias("n"),
        *[F.sum(F.when(F.col("g1") == i, F.col("c")).otherwise(0)).alias(f"a{i}") for i in range(4)],
        *[F.sum(F.when(F.col("g2") == i, F.col("c")).otherwise(0)).alias(f"b{i}") for i in range(4)],
        F.sum(F.col("c") * F.pow((F.col("g1") - F.col("g2")).cast("double"), F.lit(2.0)) / 9.0).alias("seen"),
    )
    a, b = F.array(*[F.col(f"a{i}") for i in range(4)]), F.array(*[F.col(f"b{i}") for i in range(4)])
    chance = F.aggregate(rows, F.lit(0.0), lambda s, x: s + F.pow((x["i"] - x["j"]).cast("double"), F.lit(2.0)) / 9.0 * F.element_at(a, x["i"] + 1) * F.element_at(b, x["j"] + 1)) / F.col("n")
    return n.select(F.when(chance > 0, F.lit(1.0) - F.col("seen") / chance).otherwise(0.0).alias("kappa"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Exact and within-one agreement, means, shift and Pearson correlation (0 without variance) of g1 and g2."""
    gap = F.abs(F.col("g1") - F.col("g2"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((gap == 0).cast("double")).alias("exact"),
        F.avg((gap <= 1).cast("double")).alias("within_one"),
        F.avg("g1").alias("mean_1"),
        F.avg("g2").alias("mean_2"),
        (F.avg("g2") - F.avg("g1")).alias("shift"),
        F.coalesce(F.try_divide(F.covar_pop("g1", "g2"), F.stddev_pop("g1") * F.stddev_pop("g2")), F.lit(0.0)).alias("pearson"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of the second judge's grades for each grade of the first."""
    got = pairs.groupBy("g1").pivot("g2", [0, 1, 2, 3]).agg(F.count(F.lit(1))).fillna(0)
    return got.select("g1", *[F.col(str(i)).alias(f"g2_{i}") for i in range(4)])


def histogram(grades: DataFrame, grade: str) -> DataFrame:
    """Count and share of each grade, cut to 0..3, highest first, and the share of relevant ones (2 and 3)."""
    g = grades.filter(F.col(grade).isNotNull()).select(F.greatest(F.lit(0), F.least(F.lit(3), F.col(grade))).alias("grade"))
    counts = g.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.select("grade", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.sum(F.when(F.col("grade") >= 2, F.col("n")).otherwise(0)).over(every) / F.sum("n").over(every)).alias("relevant_share"))
