"""Percentiles of large numeric columns from mergeable parts (problem 2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ordered universe: 2**LEVELS logarithmic steps between LOW and HIGH; a step is about 0.007 % wide.
LEVELS, LOW, HIGH = 21, 1e-30, 1e30
#: Compression: the rank error is at most LEVELS / FACTOR of a group's rows (0.1 %); groups under FACTOR rows keep every leaf.
FACTOR = 16_384
#: A packed node: node id above, count below.
COUNT_BITS = 40
_MASK = (1 << COUNT_BITS) - 1


def leaf(value: Column) -> Column:
    """The leaf node of a positive number; values outside LOW..HIGH go to the end leaves."""
    span = math.log(HIGH / LOW)
    step = F.floor((F.log(value) - F.lit(math.log(LOW))) / F.lit(span) * F.lit(float(1 << LEVELS)))
    return F.greatest(F.least(step, F.lit((1 << LEVELS) - 1)), F.lit(0)).cast("long") + F.lit(1 << LEVELS)


def value_of(node: np.ndarray) -> np.ndarray:
    """The geometric middle of a node's highest leaf."""
    node = np.asarray(node, dtype=np.int64)
    depth = np.frexp(node.astype(np.float64))[1] - 1
    last = ((node + 1) << (LEVELS - depth)) - 1 - (1 << LEVELS)
    return LOW * np.exp((last + 0.5) / (1 << LEVELS) * math.log(HIGH / LOW))


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move children into their parent, from the leaves up, wherever parent and both children together stay within the group's threshold."""
    for level in range(LEVELS, 0, -1):
        order = np.lexsort((node, group))
        group, node, count = group[order], node[order], count[order]
        low, high = 1 << level, 2 << level
        at = (node >= low) & (node < high)
        if not at.any():
            continue
        above = (node >= low >> 1) & (node < low)
        key = (group << (LEVELS + 2)) | np.where(at, node >> 1, node)
        use = at | above
        family, index = np.unique(key[use], return_inverse=True)
        total = np.bincount(index, weights=count[use], minlength=len(family))
        has_child = np.bincount(index, weights=at[use], minlength=len(family)) > 0
        fits = has_child & (total <= threshold[family >> (LEVELS + 2)])
        if not fits.any():
            continue
        gone = np.zeros(len(node), dtype=bool)
        gone[np.flatnonzero(use)[fits[index]]] = True
        new = family[fits]
        group = np.concatenate([group[~gone], new >> (LEVELS + 2)])
        node = np.concatenate([node[~gone], new & ((1 << (LEVELS + 2)) - 1)])
        count = np.concatenate([count[~gone], total[fits].astype(np.int64)])
    order = np.lexsort((node, group))
    return group[order], node[order], count[order]


def _flat(nodes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in nodes], dtype=np.int64)
    packed = np.concatenate([np.asarray(x, dtype=np.int64) for x in nodes]) if sizes.sum() else np.zeros(0, dtype=np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), packed


def compressor(factor: int):
    """A column function: compresses arrays of packed nodes, each a whole digest. Small digests pass unchanged."""

    @F.pandas_udf("array<long>")
    def run(nodes: pd.Series) -> pd.Series:
        group, packed = _flat(nodes)
        count = packed & _MASK
        threshold = np.bincount(group, weights=count, minlength=len(nodes)).astype(np.int64) // factor
        if (threshold == 0).all():
            return nodes
        g, n, c = compress(group, packed >> COUNT_BITS, count, threshold)
        edges = np.searchsorted(g, np.arange(len(nodes) + 1))
        both = (n << COUNT_BITS) | c
        return pd.Series([both[a:b] for a, b in zip(edges[:-1], edges[1:])])

    return run


def quantiles_of(shares: list[float]):
    """A column function: the nearest-rank quantiles of a digest, from its nodes in order of their highest leaf."""

    @F.pandas_udf("array<double>")
    def run(nodes: pd.Series) -> pd.Series:
        out = []
        for x in nodes:
            packed = np.asarray(x, dtype=np.int64)
            node, count = packed >> COUNT_BITS, packed & _MASK
            depth = np.frexp(node.astype(np.float64))[1] - 1
            last = ((node + 1) << (LEVELS - depth)) - 1
            order = np.lexsort((-depth, last))
            run_up = np.cumsum(count[order])
            ranks = [max(1, math.ceil(round(s * int(run_up[-1]), 9))) for s in shares]
            out.append(value_of(node[order][np.searchsorted(run_up, ranks)]))
        return pd.Series(out)

    return run


def _gathered(counted: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Digests from rows (keys, node, count) that are unique per key and node: at most 2**(LEVELS + 1) rows a group."""
    packed = F.shiftleft("node", COUNT_BITS).bitwiseOR(F.col("count"))
    arrays = counted.groupBy(*keys).agg(F.collect_list(packed).alias("nodes"), F.sum("count").alias("n"))
    if factor:
        arrays = arrays.withColumn("nodes", compressor(factor)("nodes"))
    return arrays


def digests(rows: DataFrame, keys: list[str], value: str, factor: int = FACTOR) -> DataFrame:
    """A q-digest per group: (keys, nodes, n).

    Values are quantised to a bounded ordered universe and counted per leaf with map-side combining, so a group
    with a third of all rows arrives as at most 2**LEVELS counts. Null, NaN, zero and negative values were not
    measured and are left out; a group without a measured value has no row. Null keys form groups of their own.
    """
    v = F.col(value)
    ok = rows.filter(v.isNotNull() & ~F.isnan(v) & (v > 0))
    counted = ok.groupBy(*keys, leaf(v).alias("node")).agg(F.count(F.lit(1)).alias("count"))
    return _gathered(counted, keys, factor)


def merge(parts: DataFrame, keys: list[str], factor: int = FACTOR) -> DataFrame:
    """Add digests up by node: parts of days, partitions or earlier runs give the digest of all their rows."""
    each = parts.select(*keys, F.explode("nodes").alias("p"))
    counted = each.groupBy(*keys, F.shiftright("p", COUNT_BITS).alias("node")).agg(F.sum(F.col("p").bitwiseAND(_MASK)).alias("count"))
    return _gathered(counted, keys, factor)


def with_quantiles(merged: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Add one column for each share."""
    got = merged.withColumn("_q", quantiles_of(list(shares.values()))("nodes"))
    return got.select(*[c for c in merged.columns if c != "nodes"], *[F.col("_q")[i].alias(k) for i, k in enumerate(shares)])


def once(records: DataFrame, id_col: str, columns: list[str], arrived: str) -> DataFrame:
    """One row per id: of several deliveries the last to arrive, then the largest; rows without an id are left out."""
    packed = F.struct(F.col(arrived), *columns)
    got = records.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(packed).alias("r"))
    return got.select(*[F.col("r")[c].alias(c) for c in columns])


def off_by(published: DataFrame, actual: DataFrame, keys: list[str], pairs: list[tuple[str, str]], tolerance: float) -> DataFrame:
    """Published rows with a figure further than ``tolerance`` from the actual one; null figures claim nothing, groups without rows have none."""
    same = None
    for k in keys:
        c = F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}"))
        same = c if same is None else same & c
    wrong = F.lit(False)
    for said, real in pairs:
        wrong = wrong | F.coalesce(F.isnan(f"s.{said}") | (F.abs(F.col(f"s.{said}") - F.col(f"a.{real}")) > F.col(f"a.{real}") * F.lit(tolerance)), F.lit(False))
    return published.alias("s").join(actual.alias("a"), same).filter(wrong).select("s.*")
