"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable  # noqa: F401

#: A term: a maximal run of letters and decimal digits, two code points or longer, of the lower-cased text.
TERM_PATTERN = r"[\p{L}\p{Nd}]{2,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(text: Column | str) -> Column:
    """All terms of a text in order; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Catalyst merges neighbouring projections and so repeats a costly expression wherever its column is used; it
    does not merge across the one-element ``inline`` here, which stays in the JVM and in the same stage.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*df.columns, made)


def measured(value: Column | str) -> Column:
    """The value, or null where it is null or not a number; -0.0 becomes 0.0 so that equal values tie."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c + F.lit(0.0))


def sampled(rows: DataFrame, id_col: str, at_most: int) -> DataFrame:
    """The ``at_most`` rows whose ids have the smallest hashes, or all where there are no more; the same rows in any partitioning.

    Of many rows only those below a hash that about twice as many keep are ordered, so that no task gets the first
    rows of every partition.
    """
    key = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    n = rows.count()
    near = rows if n <= 4 * at_most else rows.filter(key < int((1 << 40) * 2 * at_most / n))
    return near.orderBy(key, id_col).limit(at_most)


def scratch_parent(local: bool) -> str:
    """Where a task may spill: the worker's own Spark scratch disk. Only the task that writes there reads it.

    Cluster managers name it to their executors. Where one does not, it is the executor's own working folder; in local
    mode, which has neither, the system's temporary folder.
    """
    for name, between in (("SPARK_LOCAL_DIRS", ","), ("LOCAL_DIRS", ","), ("SPARK_EXECUTOR_DIRS", os.pathsep)):
        first = os.environ.get(name, "").split(between)[0]
        if first and os.path.isdir(first):
            return first
    if local:
        return tempfile.gettempdir()
    if not os.access(os.getcwd(), os.W_OK):
        raise RuntimeError("no scratch disk is named in SPARK_LOCAL_DIRS, LOCAL_DIRS or SPARK_EXECUTOR_DIRS, and the working folder cannot be written")
    return os.getcwd()


def is_local(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().isLocal()
