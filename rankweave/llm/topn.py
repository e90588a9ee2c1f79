"""Top N items within every group (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import FEW_KEYS, ranked_by_range
from . import common

#: Rows of a group that one subgroup is meant to hold; a larger group is hashed into as many as it needs.
SALT_ROWS = 20_000
#: Subgroups of every group where too many groups are large to list them.
SALTS = 64
#: Groups that ask for more items than this are ranked by value ranges instead of salted subgroups.
LONG_LIST = 20_000


def subgroups(rows: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame | None:
    """(_g, _ways): the groups over ``salt_rows`` rows and into how many subgroups each is hashed; None where there is none.

    Only the groups are read and counted. The table is broadcast; where more than ``FEW_KEYS`` groups are large it is
    empty, and every group is hashed into ``SALTS``.
    """
    counts = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    large = common.durable(counts.filter(F.col("_n") > salt_rows).select("_g", F.ceil(F.col("_n") / F.lit(salt_rows)).cast("int").alias("_ways")))
    n = large.limit(FEW_KEYS + 1).count()
    return None if not n else F.broadcast(large if n <= FEW_KEYS else large.limit(0))


def two_stages(rows: DataFrame, large: DataFrame | None, kept: Column) -> DataFrame:
    """The first ``kept`` items of every group with ``_r``, their rank in it; an item counts once with its best score."""
    order = [F.col("_s").desc(), F.col("_i")]
    ranked = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= kept)
    best = lambda df, *by: df.groupBy(*by, "_i").agg(F.max("_s").alias("_s"))
    small = lambda df: ranked(best(df.repartition("_g"), "_g"), "_g")  # noqa: E731  (such a group fits into a task: one shuffle for all)
    if large is None:
        return small(rows)
    hashed = lambda ways: F.pmod(F.xxhash64("_i"), ways).cast("int").alias("_salt")
    if large.isEmpty():
        big, usual = rows.select("*", hashed(F.lit(SALTS))), None
    else:
        big, usual = rows.join(large, "_g").select("_g", "_i", "_s", hashed(F.col("_ways"))), rows.join(large, "_g", "left_anti")
    out = ranked(ranked(best(big, "_g", "_salt"), "_g", "_salt").drop("_r", "_salt"), "_g")
    return out if usual is None else small(usual).unionByName(out)


def top_n(hits: DataFrame, limits: DataFrame, group: str, item: str, score: str, n: str, salt_rows: int = SALT_ROWS, long_list: int = LONG_LIST) -> DataFrame:
    """The first ``n`` items of each group: (group, item, score, n, rank), highest score first, then the smaller item.

    Two-stage salted ranking: a group over ``salt_rows`` rows is hashed into subgroups by its size, its repetitions are
    removed with map-side combining, the best are kept in each subgroup, and only the survivors are ranked together.
    Smaller groups take one shuffle by group for both. How many are kept is the largest ``n`` of any group, a constant, so that Spark cuts every map output to it before
    a row is sent; a group's own ``n`` is attached to the survivors. Groups that ask for more than ``long_list`` are
    ranked by value ranges, so no task sees one whole.

    An item that comes several times counts once, with its highest score. Rows whose group, item or score is null
    or whose score is not a number do not compete; infinities do. Groups without a limit, or with one that is null
    or below 1, give nothing; a limit given several times counts once, the largest holds. Further columns of either
    table are not read. Empty tables give no rows.
    """
    clean = hits.select(F.col(group).alias("_g"), F.col(item).alias("_i"), common.measured(F.col(score).cast("double")).alias("_s")).filter("_g is not null and _i is not null and _s is not null")
    limit = limits.select(F.col(group).alias("_g"), F.col(n).cast("long").alias("_n")).filter("_g is not null and _n >= 1").groupBy("_g").agg(F.max("_n").alias("_n"))
    most = limit.agg(F.max(F.when(F.col("_n") <= long_list, F.col("_n"))).alias("short"), F.max("_n").alias("all")).first()
    out = two_stages(clean, subgroups(clean, salt_rows), F.lit(most["short"] or 0)).join(limit.filter(F.col("_n") <= long_list), "_g").select("_g", "_i", "_s", "_n", "_r")
    if (most["all"] or 0) > long_list:
        long = common.durable(limit.filter(F.col("_n") > long_list))
        few = F.broadcast(long) if long.limit(FEW_KEYS + 1).count() <= FEW_KEYS else long
        out = out.unionByName(ranked_by_range(clean.join(few, "_g").groupBy("_g", "_i", "_n").agg(F.max("_s").alias("_s")), ["_g"], "_s", "_r", [F.col("_i")]).select(out.columns))
    return out.filter("_r <= _n").select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_n").alias(n), F.col("_r").cast("long").alias("rank"))
