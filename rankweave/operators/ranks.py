"""Exact ranks and percentiles inside groups of any size, without bringing a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def value_range(value: Column) -> Column:
    """A coarse code that never decreases as the value grows; about 0.4 % of the value wide, at any scale and sign."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * F.lit(1e6)) * F.lit(256.0)).cast("long")


#: Hot keys up to this number are broadcast; more are joined by shuffle.
FEW_KEYS = 10_000
#: Rows of equal value in one group that are joined to their rank in one task.
HEAVY_ROWS = 200_000


def hot_keys(rows: DataFrame, key: str, limit: int) -> DataFrame | None:
    """A table of the keys that hold more than ``limit`` rows, or None where there is none; null is no key.

    One counting job. The limit does not grow with the data, so a key below it is always small enough for one task;
    the keys stay a table, which is broadcast only where they are few.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = durable(counts.filter((F.col("_n") > limit) & F.col(key).isNotNull()).select(key))
    n = hot.count()
    if not n:
        return None
    return F.broadcast(hot) if n <= FEW_KEYS else hot


def parted(rows: DataFrame, hot: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of usual keys, nulls among them, and rows of hot keys."""
    if hot is None:
        return rows, None
    return rows.join(hot, key, "left_anti"), rows.join(hot, key, "left_semi")


def summed_by_range(df: DataFrame, group: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows before each row in its group, in a total ``order``; 0 for the first.

    Rows are cut into ranges of (group, order), so a task holds about as many rows whatever the groups are; the sums
    of a group's earlier ranges, one row each, are added. The ranges are written once to the shared folder, as they
    would differ if a lost task had to make them again.
    """
    whole = [*[F.col(g) for g in group], *order]
    cut = df.repartitionByRange(*whole).withColumn("_p", F.spark_partition_id()).withColumn("_a", amount)
    rows = durable(cut)
    sums = rows.groupBy("_p", *group).agg(F.sum("_a").alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", *group, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    joined = placed.alias("r").join(starts.alias("s"), same("r", "s", ["_p", *group]))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("r._before") + F.col("s._start")).alias(out))


def ranked_by_range(df: DataFrame, group: list[str], value: str, rank: str, ties: list[Column] | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Add the 1-based rank of each row in its group, highest value first, without a group in one task.

    With ``ties``, which make the order total, rows are ranked one by one, equal values too. Without, equal values
    share a rank (1, 1, 3): the distinct values are ranked with their counts, and a value that more than
    ``heavy_rows`` rows have is joined back in parts, cut by a hash of the row. Null groups are groups of their own.
    """
    if ties:
        return summed_by_range(df, group, [F.col(value).desc(), *ties], F.lit(1), "_before").withColumn(rank, F.col("_before") + 1).drop("_before")
    distinct = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = durable(summed_by_range(distinct, group, [F.col(value).desc()], F.col("_n"), "_before").select(*group, value, "_n", (F.col("_before") + 1).alias("_rank")))
    parts = F.ceil(F.col("_n") / F.lit(heavy_rows)).cast("int")
    keys = [*group, value]
    rows, spread = df.withColumn("_salt", F.lit(0)), ranks.withColumn("_salt", F.lit(0))
    heavy = ranks.filter(F.col("_n") > heavy_rows).select(*keys, parts.alias("_ways"))
    n = heavy.count()
    if n:
        few = F.broadcast(heavy) if n <= FEW_KEYS else heavy
        salted = df.alias("r").join(few.alias("h"), same("r", "h", keys), "left")
        rows = salted.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], F.pmod(F.xxhash64(*[F.col(f"r.{c}") for c in df.columns]), F.coalesce("h._ways", F.lit(1))).cast("int").alias("_salt"))
        spread = ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    joined = rows.alias("r").join(spread.alias("s"), same("r", "s", [*keys, "_salt"]))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], F.col("s._rank").alias(rank))


def same(a: str, b: str, keys: list[str]) -> Column:
    """Equality of the keys of two aliased tables; null equals null."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles, the value at place ceil(share x n): (keys, one column per share).

    First the rows per (group, range) are counted, which finds the range that holds each percentile and the place
    within it; then the distinct values of that range alone are counted and summed in order. A group without a
    value has no row; nulls are left out.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).filter("_v is not null").withColumn("_range", value_range(F.col("_v")))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_c").over(Window.partitionBy(*keys))
    summed = counts.withColumn("_u", F.sum("_c").over(upto)).withColumn("_n", total)
    wanted = F.array(*[F.struct(F.lit(n).alias("share"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("_n"), 9))).alias("place")) for n, q in shares.items()])
    held = summed.select(*keys, "_range", (F.col("_u") - F.col("_c")).alias("_before"), "_u", F.inline(wanted)).filter((F.col("place") > F.col("_before")) & (F.col("place") <= F.col("_u")))
    near = rows.alias("r").join(held.alias("h"), same("r", "h", [*keys, "_range"])).select(*[F.col(f"r.{k}").alias(k) for k in keys], "h.share", (F.col("h.place") - F.col("h._before")).alias("place"), "r._v")
    values = near.groupBy(*keys, "share", "place", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*keys, "share").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("_u", F.sum("_c").over(inside)).filter(F.col("_u") >= F.col("place"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("share") == n, F.col("_v"))).alias(n) for n in shares])
