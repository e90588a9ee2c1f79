"""Preparing a corpus: tags to genres, primary categories, joins of generated text, upserts and strided samples."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_language, parse_rating, parse_year, split_authors
from .ranks import summed_by_range


def catalog(books: DataFrame) -> DataFrame:
    """Raw book rows as documents: each book once (its last delivery), fields cleaned; rows without an id are left out."""
    cols = [c for c in books.columns if c not in ("book_id", "received_at")]
    last = books.filter("book_id is not null").groupBy("book_id").agg(F.max_by(F.struct(*cols), F.struct("received_at", "ratings_count")).alias("b")).select("book_id", "b.*")
    return last.select(
        "book_id",
        F.coalesce("title", F.lit("")).alias("title"),
        split_authors("authors").alias("authors"),
        parse_year("original_publication_year").alias("publication_year"),
        parse_rating("average_rating").alias("average_rating"),
        F.coalesce("ratings_count", F.lit(0)).alias("ratings_count"),
        normalize_language("language_code").alias("language"),
        F.coalesce("genre", F.lit("")).alias("genre"),
    )


def genre_map(entries: DataFrame) -> DataFrame:
    """(tag_lower, genre) from (tag, genre, place): case does not matter, the first mapping wins."""
    return entries.groupBy(F.lower("tag").alias("tag_lower")).agg(F.min_by("genre", "place").alias("genre"))


def genre_totals(tag_counts: DataFrame, tags: DataFrame) -> DataFrame:
    """Counts per (book_id, genre) from (book_id, tag, count); unmatched tags are dropped."""
    j = tag_counts.withColumn("tag_lower", F.lower("tag")).join(tags, "tag_lower")
    return j.groupBy("book_id", "genre").agg(F.sum("count").alias("n"))


def genre_lists(totals: DataFrame) -> DataFrame:
    """(book_id, genres): genres by count, then by name."""
    s = totals.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("genre").alias("g")))).alias("x"))
    return s.select("book_id", F.transform("x", lambda e: e["g"]).alias("genres"))


def primary_genre(books: DataFrame, lists: DataFrame) -> DataFrame:
    """Each book with its genres and the first of them, empty where it has none."""
    j = books.join(lists, "book_id", "left")
    return j.withColumn("primary_genre", F.coalesce(F.try_element_at("genres", F.lit(1)), F.lit(""))).withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def category_counts(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def with_text(rows: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that have a generated text that is not blank."""
    return rows.join(texts.select(key, text), key).filter(F.col(text).rlike(r"[^\s\p{Z}]"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; within either the one last in ``order`` counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    rank = F.struct("_new", order) if order else F.col("_new")
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*").select(old.columns)


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 96, attempts: int = 5, pause: float = 1.0) -> DataFrame:
    """(key, embedding): the texts sent to ``embed`` in batches; null texts are sent as empty ones.

    ``embed`` is called once for each ``batch`` of texts of a task, and again after a growing pause where it raises,
    ``attempts`` times at most; then the error is the task's.
    """
    src = rows.select(key, F.coalesce(text, F.lit("")).alias("_text"))

    def ask(texts: list[str]) -> list[list[float]]:
        for i in range(attempts):
            try:
                return embed(texts)
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(pause * 2**i)
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ask(part.column(1).to_pylist()), pa.list_(pa.float64()))], names=[key, "embedding"])

    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, embedding array<double>")


def looked_up(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Queries (query_id, text) with the ``embedding`` that ``known`` (text, embedding) holds for their text, else null; each text is looked up once."""
    once = known.filter("text is not null").groupBy("text").agg(F.min("embedding").alias("embedding"))
    return queries.join(once, "text", "left").select("query_id", "text", "embedding")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0) in a total order, by range partitions and their counts rather than one sort in one task."""
    return summed_by_range(rows, [], [F.col(c) for c in order], F.lit(1), "place")


def stride_sample(rows: DataFrame, order: list[str], take: int) -> DataFrame:
    """``take`` rows evenly spread over the sorted rows: places floor(i x count / take)."""
    n = rows.count()
    if take <= 0 or n == 0:
        return rows.limit(0)
    k = min(take, n)
    p = numbered(rows, order)
    i = F.ceil(F.col("place") * F.lit(k) / F.lit(n))
    return p.filter((F.floor(i * F.lit(n) / F.lit(k)) == F.col("place")) & (i < k)).drop("place")


def stride_sample_int(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Every (count / limit)-th row of the sorted rows, at most ``limit`` of them."""
    n = rows.count()
    if limit <= 0 or n == 0:
        return rows.limit(0)
    step = max(1, n // limit)
    return numbered(rows, order).filter((F.col("place") % step == 0) & (F.col("place") < step * limit)).drop("place")
