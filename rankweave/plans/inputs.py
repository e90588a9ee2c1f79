"""The inputs that the registered queries share."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing, text
from ..operators import corpus_stats, fuse, prep, retrieve
from ..session import cut_by, durable, durable_by, shared_folder
from ..sources.tables import read_table
from ..spec import CorpusSpec

STRIPES = ["a", "b"]
TOP, DEPTH = 10, 50
LANGUAGE_STRIPES = [("en", "a"), ("de", "b"), ("fr", "b"), ("es", "b")]
# Genres of tags as readers write them.
GENRE_TAGS = [("fantasy", "Speculative"), ("science fiction", "Speculative"), ("horror", "Speculative"), ("mystery", "Crime"), ("thriller", "Crime"), ("romance", "Love"), ("history", "Fact"), ("memoir", "Fact"), ("biography", "Fact"), ("Fantasy", "Shadowed")]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their searchable fields (title, authors, text) and the stripe of their language; null texts are empty."""
    groups = spark.createDataFrame(LANGUAGE_STRIPES, "category string, stripe string")
    books = prep.catalog(read_table(spark, d, "books")).select("book_id", F.array_join("authors", " ").alias("authors"))
    docs = read_table(spark, d, "documents").select("doc_id", "book_id", "title", F.coalesce("text", F.lit("")).alias("text"), text.normalize_language("lang").alias("language"))
    return routing.by_category(docs.join(books, "book_id", "left"), "language", groups, "doc_id")


SPEC = CorpusSpec(text_cols=("title", "authors", "text"))


def evaluation_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text): each evaluation query once, with the last text delivered for it; null where there never was one."""
    q = read_table(spark, d, "eval_queries").filter("query_id is not null")
    return q.groupBy("query_id").agg(F.max_by("text", F.struct(F.col("text").isNotNull(), "received_at", "text")).alias("text"))


def stated_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: the evaluation queries whose number is divisible by 50."""
    return evaluation_queries(spark, d).filter(number_of("query_id") % 50 == 0)


def number_of(query_id: str) -> Column:
    return F.regexp_extract(query_id, r"\d+", 0).try_cast("bigint")


@dataclass
class Index:
    """The stored index of a corpus: postings and statistics, each written once to the shared folder when first used.

    Postings are cut by document, so that what is counted per document later needs no shuffle.
    """

    spark: SparkSession
    d: str
    stop: bool = True

    @cached_property
    def postings(self) -> DataFrame:
        """(doc_id, stripe, doc_len, term, tf), and for each document a row with the empty term."""
        toks = corpus_stats.tokenized(corpus(self.spark, self.d), SPEC, self.stop)
        return durable(retrieve.postings(toks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    @cached_property
    def lengths(self) -> DataFrame:
        return self.postings.filter("term = ''").select("doc_id", "stripe", "doc_len")

    @cached_property
    def df_local(self) -> DataFrame:
        return durable(self.postings.filter("term <> ''").groupBy("stripe", "term").agg(F.count(F.lit(1)).alias("df")))

    @cached_property
    def df_global(self) -> DataFrame:
        return durable(corpus_stats.df_global(self.df_local))

    @cached_property
    def sizes(self) -> DataFrame:
        return durable(corpus_stats.sizes(self.lengths))

    @cached_property
    def size(self) -> DataFrame:
        return durable(corpus_stats.global_size(self.lengths))


_KEPT: OrderedDict = OrderedDict()


def kept(kind: str, spark: SparkSession, d: str, tables: list[str], make: Callable[[], object]) -> object:
    """What ``make`` made of some tables, for the next query of the session. A few are kept.

    It is made again when one of the tables changes or when the shared folder, where its parts are written, is another
    one or was cleared: an empty file there stands for them.
    """
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    at = lambda name: (path(name), path(name).getFileSystem(conf))
    stamps = tuple(fs.getFileStatus(p).getModificationTime() for p, fs in (at(f"{d}/{t}.parquet") for t in tables))
    key = (spark.sparkContext.applicationId, kind, d, shared_folder(spark))
    held = _KEPT.pop(key, None)
    if held is not None:
        mark, fs = at(held[1])
        held = held if held[0] == stamps and fs.exists(mark) else None
    if held is None:
        name = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        mark, fs = at(name)
        fs.create(mark).close()
        held = (stamps, name, make())
    _KEPT[key] = held
    while len(_KEPT) > 8:
        _KEPT.popitem(last=False)
    return held[2]


def index_of(spark: SparkSession, d: str, stop: bool = True) -> Index:
    return kept(f"index {stop}", spark, d, ["documents", "books"], lambda: Index(spark, d, stop))


def retrieved(spark: SparkSession, d: str, everything: bool = False) -> Retrieved:
    """The retrieval of the stated query set, or of every evaluation query."""
    texts = evaluation_queries if everything else stated_queries
    return kept(f"retrieved {everything}", spark, d, ["documents", "books", "eval_queries"], lambda: Retrieved(spark, d, texts(spark, d)))


@dataclass
class Retrieved:
    """Everything one retrieval of a query set (query_id, text) yields; each part is made when it is first used."""

    spark: SparkSession
    d: str
    texts: DataFrame
    stop: bool = True

    @cached_property
    def queries(self) -> DataFrame:
        return durable(self.texts)

    @cached_property
    def index(self) -> Index:
        return index_of(self.spark, self.d, self.stop)

    @cached_property
    def qterms(self) -> DataFrame:
        return durable(retrieve.terms_of(self.queries, self.stop))

    @cached_property
    def matched(self) -> DataFrame:
        """The postings of the query set's terms; they stay cut by document."""
        return durable(retrieve.matching(self.index.postings.filter("term <> ''"), self.qterms))

    @cached_property
    def df_local(self) -> DataFrame:
        """Counted on the fly for the queries' terms only."""
        return durable(retrieve.probe(self.matched))

    @cached_property
    def df_global(self) -> DataFrame:
        return corpus_stats.df_global(self.df_local)

    @property
    def sizes(self) -> DataFrame:
        return self.index.sizes

    @property
    def size(self) -> DataFrame:
        return self.index.size

    def lists(self, top: int, where: DataFrame | None = None) -> DataFrame:
        """``where`` (doc_id) keeps some documents only; statistics stay those of all."""
        near = self.matched if where is None else self.matched.join(where, "doc_id", "left_semi")
        return retrieve.lists(near, self.qterms, self.df_local, self.sizes, (self.df_global, self.size), top)

    def keyword(self, top: int, where: DataFrame | None = None) -> DataFrame:
        return self.opened(cut_by(self.lists(top, where), "query_id"))

    def opened(self, found: DataFrame, order: list[str] = STRIPES) -> DataFrame:
        return retrieve.opened(found, order).withColumn("vector_similarity", F.lit(None).cast("double"))

    @cached_property
    def per_index(self) -> DataFrame:
        """The best of each stripe, with second-stage scores; the lists are written once and are cut by query."""
        return retrieve.semantic(self.opened(durable_by(self.lists(DEPTH), "query_id")), self.matched, self.qterms)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.per_index.filter(F.col("hit_rank") <= retrieve.budget(len(STRIPES)))

    @cached_property
    def flat(self) -> DataFrame:
        """The same retrieval over the un-split corpus; ``home`` is a hit's stripe."""
        near = self.matched.withColumn("home", F.col("stripe")).withColumn("stripe", F.lit("all"))
        df, size = (x.withColumn("stripe", F.lit("all")) for x in (self.df_global, self.size))
        return self.opened(durable_by(retrieve.lists(near, self.qterms, df, size, top=DEPTH), "query_id"), ["all"])

    @cached_property
    def oracle(self) -> DataFrame:
        """The un-split retrieval; hits keep their home stripe's label."""
        return retrieve.semantic(self.flat.drop("stripe").withColumnRenamed("home", "stripe"), self.matched, self.qterms)

    def chosen(self, threshold: float) -> DataFrame:
        return fuse.selected(self.queries, STRIPES, fuse.yields(self.qterms, self.df_global, self.size, self.df_local), threshold)


def halves(queries: DataFrame) -> DataFrame:
    """(query_id, sub_id, text): a stand-in for a planner's rewrites, the first and the second half of a query's terms. A query of one term or none stays whole."""
    n = F.ceil(F.size("_t") / F.lit(2)).cast("int")
    first, rest = F.array_join(F.slice("_t", F.lit(1), F.greatest(n, F.lit(1))), " "), F.array_join(F.slice("_t", n + 1, F.size("_t")), " ")
    parts = F.when(F.size("_t") < 2, F.array("text")).otherwise(F.array(first, rest))
    subs = queries.withColumn("_t", text.query_terms("text")).select("query_id", F.posexplode(parts).alias("_i", "text"))
    return subs.select("query_id", F.concat("query_id", F.lit("."), (F.col("_i") + 1).cast("string")).alias("sub_id"), "text")


def whole_of(sub_id: str) -> Column:
    """The query of a subquery that ``halves`` made."""
    return F.regexp_extract(sub_id, r"(?s)^(.*)\.\d+$", 1)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """The delivered candidates of every query and mode."""
    return fuse.clean(read_table(spark, d, "candidates"))


def stored_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents per stored stripe."""
    return read_table(spark, d, "documents").filter("stripe is not null").groupBy("stripe").agg(F.count(F.lit(1)).alias("n_docs"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), routing.by_hash("vec_id").alias("stripe"), "embedding", "label")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (query_id, embedding): every vector whose id is divisible by 50."""
    return read_table(spark, d, "embeddings").filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
