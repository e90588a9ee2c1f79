"""Readers and writers of the engine's files."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import mix_text
from ..spec import Split

# The columns of a results file, in order.
RESULT_COLUMNS = (
    "queryId query shape span intent mode strategy ndcg recall jaccard kendallTau rbo judgedNdcg judgedCoverage "
    "queries computeUnits agenticTokens modelTokens latencyMs stripeMix"
).split()
METRIC_COLUMNS = ["ndcg", "recall", "jaccard", "kendallTau", "rbo"]
QUERY_SCHEMA = "id string, text string, shape string, span string, intent string"


def fetch(url: str, path: str) -> bool:
    """Download a raw file to the driver, unless it is there already; true if it was fetched. It is put in place when whole."""
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with urllib.request.urlopen(url) as source, open(f"{path}.part", "wb") as out:
        shutil.copyfileobj(source, out)
    os.replace(f"{path}.part", path)
    return True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_books_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; rows whose id is no number are skipped."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.withColumn("book_id", F.col("book_id").try_cast("bigint")).filter("book_id is not null")


def read_counts_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(goodreads_book_id, tag_id, count): plain numbers; lines that are malformed are skipped."""
    schema = "goodreads_book_id bigint, tag_id bigint, count bigint"
    return spark.read.csv(path, schema=schema, header=header, mode="DROPMALFORMED").dropna()


def read_tags_csv(spark: SparkSession, path: str) -> DataFrame:
    """(tag_id, tag_name): each line cut at its first comma, so names may hold commas."""
    line = spark.read.text(path)
    pattern = r"^\s*(\d+),(.*)$"
    good = line.filter(F.col("value").rlike(pattern))
    return good.select(F.regexp_extract("value", pattern, 1).cast("bigint").alias("tag_id"), F.trim(F.regexp_extract("value", pattern, 2)).alias("tag_name"))


def read_corpus_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array of documents; fields that are left out are null."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of a task as the lines of one JSON array."""
    before = "["
    for batch in batches:
        lines = []
        for x in batch.column(0).to_pylist():
            lines.append(before + x)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])


def write_corpus_json(df: DataFrame, path: str) -> None:
    """JSON arrays of documents, one a file; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, divided by ``partition`` (the stripe) where given: one sub-folder an index; Spark retries failed tasks."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(parsed fields, failed): lines that cannot be parsed are kept with ``failed`` true, so that they can be counted."""
    fields = T.StructType.fromDDL(schema).fieldNames()
    lines = spark.read.text(path).filter(F.trim("value") != "")
    both = lines.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return both.select(*[F.col(f"r.{f}").alias(f) for f in fields], F.col("r._broken").isNotNull().alias("failed"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A query set; an id that occurs twice is an error."""
    q = spark.read.schema(QUERY_SCHEMA).json(path, multiLine=True)
    twice = [r["id"] for r in duplicated(q, "id").limit(5).collect()]
    if twice:
        raise ValueError(f"query ids occur more than once: {', '.join(map(str, twice))}")
    return q.withColumnRenamed("id", "query_id")


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def save_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """Statistics tables, each stamped with and divided by the name of the split; those without a name stay unqualified."""
    for name, t in tables.items():
        stamped = t if "split" in t.columns else t.withColumn("split", F.lit(None).cast("string"))
        stamped.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")


def load_statistics(spark: SparkSession, path: str, split: Split) -> dict[str, DataFrame]:
    """The tables of one split; where there are none, the unqualified ones. Statistics stamped with another split are an error, never a fallback."""
    out, wanted = {}, None
    for name in ("global", "stripe", "df_global", "df_local"):
        t = spark.read.parquet(f"{path}/{name}")
        t = t.withColumn("split", F.col("split").cast("string"))
        if wanted is None:
            have = {r["split"] for r in t.select("split").distinct().limit(100).collect()}
            if split.name not in have and None not in have:
                raise ValueError(f"no statistics for split {split.name!r}; there are {sorted(have)}")
            wanted = F.col("split") == split.name if split.name in have else F.col("split").isNull()
        out[name] = t.filter(wanted)
    return out


def result_rows(records: DataFrame) -> DataFrame:
    """Evaluation records as the rows of a results file: nulls blank, doubles in full, the stripe mix as text."""
    names = dict(zip(RESULT_COLUMNS, "query_id query_text shape span intent mode strategy ndcg recall jaccard kendall_tau rbo judged_ndcg judged_coverage queries compute_units agentic_tokens model_tokens latency_ms stripe_mix".split()))

    def cell(c: str) -> Column:
        if c not in records.columns:
            return F.lit(None).cast("string")
        return mix_text(F.col(c)) if isinstance(records.schema[c].dataType, T.MapType) else F.col(c).cast("string")

    return records.select(*[cell(c).alias(k) for k, c in names.items()])


def write_results(records: DataFrame, path: str) -> None:
    result_rows(records).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file by its header, whatever the case of the names; rows with a metric that is no number are dropped."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    by_name = {c.lower(): c for c in raw.columns}
    missing = [c for c in ("queryId", "mode", "strategy") if c.lower() not in by_name]
    if missing:
        raise ValueError(f"columns missing from the results file: {missing}")
    numeric = {*METRIC_COLUMNS, "judgedNdcg", "judgedCoverage", "queries", "computeUnits", "agenticTokens", "modelTokens", "latencyMs"}
    cols = [(c, by_name[c.lower()]) for c in RESULT_COLUMNS if c.lower() in by_name]
    got = raw.select(*[(F.col(f"`{own}`").try_cast("double") if c in numeric else F.col(f"`{own}`")).alias(c) for c, own in cols])
    return got.dropna(subset=[c for c in METRIC_COLUMNS if c in got.columns])


def write_pool(pool: DataFrame, path: str, spark: SparkSession) -> None:
    """Union with what is there already, one sorted list of documents a query; written beside and then put in place."""
    try:
        old = spark.read.parquet(path).select("query_id", F.explode("doc_ids").alias("doc_id"))
        both = pool.select("query_id", "doc_id").unionByName(old)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = pool.select("query_id", "doc_id")
    lists = both.distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    lists.write.mode("overwrite").parquet(f"{path}.next")
    spark.read.parquet(f"{path}.next").write.mode("overwrite").parquet(path)


def read_pools(spark: SparkSession, *paths: str) -> DataFrame:
    """(query_id, doc_id) of every pool file, each pair once."""
    return spark.read.parquet(*paths).select("query_id", F.explode("doc_ids").alias("doc_id")).distinct()


def register(df: DataFrame, name: str) -> None:
    """Create or replace an index as a view."""
    df.createOrReplaceTempView(name)


def drop(spark: SparkSession, name: str) -> bool:
    """Remove an index; false where there is none."""
    return spark.catalog.dropTempView(name)


def stripe_catalog(corpus: DataFrame, stripe: str = "stripe") -> DataFrame:
    """The registered sources: one row per stripe with its number of documents."""
    return corpus.groupBy(F.col(stripe).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
