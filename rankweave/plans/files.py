"""The engine's files, written from the tables and read back: one query for each reader, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import corpus_stats, evaluate
from ..session import shared_folder
from ..sources import tables
from ..sources.tables import read_table
from ..spec import Split


def _place(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def books_csv(spark, d):
    """Quoted CSV; a line whose id is no number is left out."""
    path = _place(spark, "books")
    b = read_table(spark, d, "books").filter("title is not null").select(F.coalesce(F.col("book_id").cast("string"), F.lit("none")).alias("book_id"), "title", F.coalesce("authors", F.lit("")).alias("authors"))
    b.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = tables.read_books_csv(spark, path)
    return got.groupBy("book_id", "title", F.coalesce("authors", F.lit("")).alias("authors")).agg(F.count(F.lit(1)).alias("n"))


def counts_csv(spark, d):
    """Plain numbers; a line with a word in it is left out."""
    path = _place(spark, "counts")
    c = read_table(spark, d, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") == 1, F.lit("one")).otherwise(F.col("l_linenumber").cast("string"))).alias("value"))
    c.write.text(path)
    got = tables.read_counts_csv(spark, path, header=False)
    return got.groupBy("goodreads_book_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


def tags_csv(spark, d):
    """Names may hold commas."""
    path = _place(spark, "tags")
    t = read_table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.coalesce("p_name", F.lit("")), F.lit(", "), F.coalesce("p_type", F.lit(""))).alias("value"))
    t.write.text(path)
    return tables.read_tags_csv(spark, path)


def corpus_json(spark, d):
    """A JSON corpus with its vectors as base64: the largest error of a component, in steps of the scale."""
    path = _place(spark, "corpus")
    e = read_table(spark, d, "embeddings").select("vec_id", "label", payloads.encoded(F.col("embedding")).alias("vector"), F.col("embedding"))
    tables.write_corpus_json(e, path)
    back = tables.read_corpus_json(spark, path, "vec_id long, label int, vector string, embedding array<float>").withColumn("v", payloads.decoded("vector"))
    step = F.array_max(F.transform("embedding", lambda x: F.abs(x))) / 127
    gap = F.array_max(F.zip_with("v", "embedding", lambda x, y: F.abs(x - y)))
    return back.select("vec_id", "label", F.size("v").alias("size"), (gap <= step * 0.501 + 1e-6).alias("close"))


def jsonl(spark, d):
    """One object a line; every line that is no object is counted as failed."""
    path = _place(spark, "lines")
    q = read_table(spark, d, "eval_queries").select("query_id", "text")
    lines = q.select(F.when(F.coalesce(F.crc32("query_id") % 7, F.lit(0)) == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("query_id", "text"))).alias("value"))
    lines.write.text(path)
    got = tables.read_jsonl(spark, path, "query_id string, text string")
    return got.groupBy("query_id", "text", "failed").agg(F.count(F.lit(1)).alias("n"))


def jsonl_written(spark, d):
    path = _place(spark, "written")
    tables.write_jsonl(read_table(spark, d, "doc_probes"), path)
    return tables.read_jsonl(spark, path, "doc_id long, probe_batch string").groupBy("doc_id", "probe_batch", "failed").agg(F.count(F.lit(1)).alias("n"))


def query_set(spark, d):
    """A query file; its ids are unique, else it is refused."""
    path = _place(spark, "queries")
    q = read_table(spark, d, "eval_queries").filter("query_id is not null").groupBy(F.col("query_id").alias("id")).agg(F.max("text").alias("text"))
    tables.write_corpus_json(q, path)
    return tables.load_queries(spark, path).select("query_id", "text")


def statistics(spark, d):
    """Statistics saved for one split and unqualified ones; each split loads its own, another the unqualified."""
    path = _place(spark, "statistics")
    toks = corpus_stats.tokenized(read_table(spark, d, "documents").filter("stripe is not null"))
    own = corpus_stats.tables_of(toks, Split("category"))
    plain = {k: v.withColumn("split", F.lit(None).cast("string")) for k, v in own.items()}
    tables.save_statistics({k: v.unionByName(plain[k]) for k, v in own.items()}, path)
    out = None
    for split in (Split("category"), Split("hash")):
        got = tables.load_statistics(spark, path, split)["df_local"].select(F.lit(split.name).alias("asked"), F.coalesce("split", F.lit("none")).alias("got"), "stripe", "term", "df")
        out = got if out is None else out.unionByName(got)
    return out


def results(spark, d):
    """A results file, read back by its header."""
    path = _place(spark, "results")
    r = evaluate.once(read_table(spark, d, "eval_records")).filter("ndcg is not null and not isnan(ndcg)")
    r = r.select("record_id", "query_id", "mode", "strategy", "ndcg", F.col("ndcg").alias("recall"), F.lit(0.5).alias("jaccard"), F.lit(0.25).alias("kendall_tau"), F.lit(0.125).alias("rbo"), "judged_ndcg", "agentic_tokens", "stripe_mix")
    tables.write_results(r, path)
    got = tables.read_results(spark, path)
    return got.groupBy(F.col("queryId").alias("query_id"), "mode", "strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("judgedNdcg"), 9).alias("judged_ndcg"), F.sum("agenticTokens").cast("long").alias("tokens"), F.count("stripeMix").alias("mixes"))


def pools(spark, d):
    """Two pools written one after the other into one file, and a third beside it, read together."""
    path, other = _place(spark, "pool"), _place(spark, "pool")
    c = read_table(spark, d, "candidates").filter("query_id is not null and doc_id is not null")
    for stripe in ("a", "b"):
        tables.write_pool(c.filter(F.col("stripe") == stripe), path, spark)
    tables.write_pool(c.filter("hit_rank = 1"), other, spark)
    return tables.read_pools(spark, path, other)


def index_files(spark, d):
    """An index written by stripe, registered as a view, read and dropped."""
    path, name = _place(spark, "index"), f"index_{uuid.uuid4().hex}"
    tables.write_corpus(read_table(spark, d, "documents").filter("stripe is not null").select("doc_id", "stripe", "lang"), path, "stripe")
    tables.register(spark.read.parquet(path), name)
    got = spark.table(name).groupBy("stripe").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    tables.drop(spark, name)
    return got


QUERIES = {f"file_{f.__name__}": f for f in (books_csv, counts_csv, tags_csv, corpus_json, jsonl, jsonl_written, query_set, statistics, results, pools, index_files)}


def oracle_sql(tokens: str, records: str) -> dict[str, str]:
    """``tokens``: an expression for the terms of ``text``; ``records``: a common table ``rec`` of each record once."""
    local = f"SELECT stripe, term, count(*) AS df FROM (SELECT stripe, unnest(list_distinct({tokens})) AS term FROM documents WHERE stripe IS NOT NULL) GROUP BY ALL"
    return {
        "file_books_csv": "SELECT book_id, title, coalesce(authors, '') AS authors, count(*) AS n FROM books WHERE book_id IS NOT NULL AND title IS NOT NULL GROUP BY ALL",
        "file_counts_csv": "SELECT l_orderkey AS goodreads_book_id, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL",
        "file_tags_csv": "SELECT p_partkey AS tag_id, trim(coalesce(p_name, '') || ', ' || coalesce(p_type, '')) AS tag_name FROM part",
        "file_corpus_json": "SELECT vec_id, label, len(embedding)::INT AS size, TRUE AS close FROM embeddings",
        "file_jsonl_written": "SELECT doc_id, probe_batch, FALSE AS failed, count(*) AS n FROM doc_probes GROUP BY ALL",
        "file_query_set": "SELECT query_id, max(text) AS text FROM eval_queries WHERE query_id IS NOT NULL GROUP BY ALL",
        "file_statistics": f"WITH l AS ({local}) SELECT 'category' AS asked, 'category' AS got, * FROM l UNION ALL SELECT 'random-42', 'none', * FROM l",
        "file_results": f"WITH {records} SELECT query_id, mode, strategy, count(*) AS n, round(avg(ndcg), 9) AS ndcg, round(avg(judged_ndcg), 9) AS judged_ndcg, sum(agentic_tokens)::BIGINT AS tokens, count(stripe_mix) AS mixes FROM rec WHERE ndcg IS NOT NULL AND NOT isnan(ndcg) GROUP BY ALL",
        "file_pools": "SELECT DISTINCT query_id, doc_id FROM candidates WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND (stripe IN ('a', 'b') OR hit_rank = 1)",
        "file_index_files": "SELECT stripe, count(*) AS n_docs, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE stripe IS NOT NULL GROUP BY ALL",
    }
