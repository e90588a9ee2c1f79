import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import corpus_stats
from rankweave.sources import report, tables
from rankweave.spec import CorpusSpec, Split
from rankweave.streaming import increment


def test_csv_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text('book_id,title\n1,"One, and ""more"""\nx,bad\n2,Two\n')
    assert [tuple(r) for r in tables.read_books_csv(spark, str(tmp_path / "b.csv")).collect()] == [(1, 'One, and "more"'), (2, "Two")]
    (tmp_path / "c.csv").write_text("goodreads_book_id,tag_id,count\n1,2,3\n1,x,3\n4,5\n")
    assert [tuple(r) for r in tables.read_counts_csv(spark, str(tmp_path / "c.csv")).collect()] == [(1, 2, 3)]
    (tmp_path / "t.csv").write_text("tag_id,tag_name\n7,sword, sorcery\nno,line\n")
    assert [tuple(r) for r in tables.read_tags_csv(spark, str(tmp_path / "t.csv")).collect()] == [(7, "sword, sorcery")]


def test_json_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "text": "x", "shape": "Head"}, {"id": "b", "text": "y"}]))
    assert [r["query_id"] for r in tables.load_queries(spark, str(tmp_path / "q.json")).collect()] == ["a", "b"]
    (tmp_path / "q2.json").write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    with pytest.raises(ValueError, match="a"):
        tables.load_queries(spark, str(tmp_path / "q2.json"))
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    tables.write_jsonl(df, str(tmp_path / "l"))
    (tmp_path / "l" / "part-extra.txt").write_text("not json\n")
    got = tables.read_jsonl(spark, str(tmp_path / "l"), "k int, v string").orderBy("k").collect()
    assert [r["failed"] for r in got] == [True, False, False] and got[2]["v"] is None


def test_broken_lines_are_counted(spark, small):
    from rankweave.plans import files

    got = files.jsonl(spark, small).collect()
    n = spark.read.parquet(f"{small}/eval_queries.parquet").count()
    broken = spark.read.parquet(f"{small}/eval_queries.parquet").filter("coalesce(crc32(query_id) % 7, 0) = 0").count()
    assert sum(r["n"] for r in got) == n and sum(r["n"] for r in got if r["failed"]) == broken > 0
    assert all(r["query_id"] is None for r in got if r["failed"])


def test_fetch(tmp_path):
    (tmp_path / "source").write_bytes(b"abc")
    path = str(tmp_path / "raw" / "file")
    assert tables.fetch((tmp_path / "source").as_uri(), path) and not tables.fetch("file:///nowhere", path)
    assert open(path, "rb").read() == b"abc"


def test_embedding_in_batches_with_retries(spark):
    from rankweave.operators import prep

    def flaky(texts):
        import random

        if len(texts) > 4 or random.random() < 0.3:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(30)], "id int, text string")
    got = {r["id"]: list(r["embedding"]) for r in prep.embedded(df, "id", "text", flaky, batch=4, attempts=20, pause=0.0).collect()}
    assert got == {i: [float(i)] for i in range(30)}
    with pytest.raises(Exception, match="busy"):
        prep.embedded(df, "id", "text", flaky, batch=5, attempts=2, pause=0.0).collect()


def test_results_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("q1", 'say "a", b', "K", "naive", 0.1, 0.2, 0.3, 0.4, 0.5, None, {"b": 9, "a": 1})], "query_id string, query_text string, mode string, strategy string, ndcg double, recall double, jaccard double, kendall_tau double, rbo double, judged_ndcg double, stripe_mix map<string,int>")
    tables.write_results(r, str(tmp_path / "r"))
    got = tables.read_results(spark, str(tmp_path / "r")).first()
    assert got["ndcg"] == 0.1 and got["judgedNdcg"] is None and got["stripeMix"] == "a=1 | b=9" and got["query"] == 'say "a", b'
    (tmp_path / "bad.csv").write_text("QUERYID,Mode,strategy,ndcg\nq,K,s,0.5\nq,K,s,oops\n")
    assert tables.read_results(spark, str(tmp_path / "bad.csv")).count() == 1


def test_statistics_belong_to_their_split(spark, tmp_path):
    docs = spark.createDataFrame([(1, "dragon wizard", "a"), (2, "dragon", "b"), (3, None, "b")], "doc_id long, text string, stripe string")
    s = corpus_stats.build(docs, CorpusSpec(), Split("category"))
    tables.save_statistics(s, str(tmp_path / "s"))
    back = tables.load_statistics(spark, str(tmp_path / "s"), Split("category"))
    assert {(r["term"], r["df"]) for r in back["df_global"].collect()} == {("dragon", 2), ("wizard", 1)}
    with pytest.raises(ValueError, match="random-42"):
        tables.load_statistics(spark, str(tmp_path / "s"), Split("hash"))
    plain = {k: v.drop("split") for k, v in s.items()}
    tables.save_statistics(plain, str(tmp_path / "u"))
    for split in (Split("category"), Split("hash")):  # unqualified statistics serve any split
        assert tables.load_statistics(spark, str(tmp_path / "u"), split)["df_local"].count() == 3
    both = {k: v.unionByName(plain[k].withColumn("split", F.lit(None).cast("string"))) for k, v in s.items()}
    tables.save_statistics(both, str(tmp_path / "b"))
    assert {r["split"] for r in tables.load_statistics(spark, str(tmp_path / "b"), Split("category"))["df_local"].collect()} == {"category"}
    assert {r["split"] for r in tables.load_statistics(spark, str(tmp_path / "b"), Split("hash"))["df_local"].collect()} == {None}
    roll = {(r["term"], r["scope"]): r["df"] for r in corpus_stats.df_rollup(corpus_stats.tokenized(docs)).collect()}
    assert roll[("dragon", "all")] == 2 and roll[("dragon", "a")] == 1


def test_pool_grows(spark, tmp_path):
    a = spark.createDataFrame([("q", 2), ("q", 1)], "query_id string, doc_id long")
    path = str(tmp_path / "pool")
    tables.write_pool(a, path, spark)
    tables.write_pool(spark.createDataFrame([("q", 3), ("q", 1)], "query_id string, doc_id long"), path, spark)
    assert spark.read.parquet(path).first()["doc_ids"] == [1, 2, 3]
    assert tables.read_pools(spark, path).count() == 3


def test_report(spark):
    text = report.report("Keyword", summary=spark.createDataFrame([("naive", 0.12345, None, 0.00001)], "strategy string, ndcg double, judged double, t_p double"))
    assert "| naive | 0.123 | — | <0.0001 |" in text
    with pytest.raises(ValueError):
        report.section("x", spark.range(3000))
    assert report.run_name("category", "lexical", ["Keyword"], "other", 10) == "category.lexical.keyword.judge-other.first10"


def test_stream_keeps_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "dragon wizard", "a"), (2, "dragon", "b")], "doc_id long, text string, stripe string")
    src = str(tmp_path / "in")
    docs.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).parquet(src)
        increment.maintain(stream, str(tmp_path / "df"), str(tmp_path / "cp")).awaitTermination()
    got = increment.compacted(spark.read.parquet(str(tmp_path / "df")))
    assert {(r["stripe"], r["term"], r["df"]) for r in got.collect()} == {("a", "dragon", 1), ("a", "wizard", 1), ("b", "dragon", 1)}
    docs.withColumn("doc_id", F.col("doc_id") + 2).write.mode("append").parquet(src)
    increment.maintain(spark.readStream.schema(docs.schema).parquet(src), str(tmp_path / "df"), str(tmp_path / "cp")).awaitTermination()
    got = increment.compacted(spark.read.parquet(str(tmp_path / "df")))
    assert {(r["stripe"], r["term"], r["df"]) for r in got.collect()} == {("a", "dragon", 2), ("a", "wizard", 2), ("b", "dragon", 2)}
