"""Which stripe a document belongs to, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(key: Column | str, seed: int = 42) -> Column:
    """Stripe of ``sha256(key:seed)``: the lowest bit of the first byte, 0 for a, 1 for b."""
    k = F.col(key) if isinstance(key, str) else key
    first = F.conv(F.substring(F.sha2(F.concat(k.cast("string"), F.lit(f":{seed}")), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "a").otherwise("b")


def by_year(year: Column | str, cut: int, key: Column | str, seed: int = 42) -> Column:
    """Stripe a up to the cut, b after it; without a year the hash decides."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y.isNull(), by_hash(key, seed)).when(y <= cut, "a").otherwise("b")


def by_category(docs: DataFrame, category: str, groups: DataFrame, key: str, seed: int = 42, out: str = "stripe") -> DataFrame:
    """Add the stripe of a document's category; unknown and null categories fall to the hash.

    ``groups`` (category, stripe) is a small dictionary; case does not matter and the first mapping wins, in the
    order of the stripes' names.
    """
    known = groups.select(F.lower("category").alias("_c"), F.col("stripe").alias("_s")).groupBy("_c").agg(F.min("_s").alias("_s"))
    joined = docs.withColumn("_c", F.lower(F.col(category))).join(known, "_c", "left")
    return joined.withColumn(out, F.coalesce("_s", by_hash(key, seed))).drop("_c", "_s")


def with_oracle(docs: DataFrame, stripe: str = "stripe") -> DataFrame:
    """Each document twice: once for its stripe, once for the un-split index, where it keeps its stripe's label."""
    arms = F.array(F.struct(F.lit("stripes").alias("arm"), F.col(stripe).alias("index_name")), F.struct(F.lit("oracle").alias("arm"), F.lit("all").alias("index_name")))
    return docs.select("*", F.inline(arms))
