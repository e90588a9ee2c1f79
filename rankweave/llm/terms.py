"""Term frequencies of a whole collection (problem 1) and term weights per record (problem 4)."""

from __future__ import annotations

import math
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RARE_AT_MOST = 2
COMMON_OVER = 0.38
#: Rows of one radix partition that a task aggregates without splitting it further.
SPLIT_ROWS = 2_000_000
#: Distinct (term, stripe) rows that a map task holds before it passes them on.
FLUSH_ROWS = 1_000_000
RADIX_BITS = 4
_BASIC = "term string, stripe string, document_frequency long, occurrences long"
_STATS = "term string, document_frequency long, occurrences long, stripes array<struct<stripe:string,document_frequency:long,occurrences:long>>"


#: Row of ``term_statistics`` that counts the records with a term; no term is empty.
EVERY = ""
#: Terms whose statistics are broadcast to the postings: the most frequent ones, at most so many.
HOT_TERMS = 100_000
#: Records that the language profile is fitted to, at most, words of it for each language, and languages.
SAMPLE, PROFILE_WORDS, LANGUAGES = 20_000, 100, 50


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Rows (d, term, tf) of a batch that has a list column ``terms``; d is the row's place in the batch."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    flat = pa.table({"d": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
    return flat.group_by(["d", "term"]).aggregate([([], "count_all")]).rename_columns(["d", "term", "tf"])


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per record and distinct term, with the number of occurrences ``tf``; no shuffle.

    ``keys`` are carried along. Records without a term (null, empty, blank or unworded texts) give no rows.
    """
    src = docs.select(*keys, common.terms(text).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _counted(batch)
            carried = pa.Table.from_batches([batch]).select(keys).take(found["d"])
            for name in ("term", "tf"):
                carried = carried.append_column(name, found[name])
            yield from carried.combine_chunks().to_batches(max_chunksize=65_536)

    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, f"{schema}, term string, tf long")


@dataclass
class Profile:
    """Words that tell languages apart, and the log share of each language's records that hold them; a bounded table."""

    words: list[str]
    names: list[str]
    logs: np.ndarray

    def of(self, found: pa.Table, rows: int, label: pa.Array) -> pa.Array:
        """The language of each row by the words it holds, each once; without any of them its label."""
        if not self.words:
            return label
        at = pc.index_in(found["term"], pa.array(self.words, pa.string()))
        hit = pc.is_valid(at)
        d, w = (np.asarray(x.filter(hit)) for x in (found["d"], at))
        score = np.zeros((rows, len(self.names)))
        np.add.at(score, d, self.logs[w])
        best = pa.array(self.names, pa.string()).take(pa.array(score.argmax(axis=1)))
        return pc.if_else(pa.array(np.bincount(d, minlength=rows) > 0), best, label)


def _code(label: Column) -> Column:
    """The first two letters of a language code, so that spellings of one meet; blank gives null."""
    letters = F.substring(F.lower(F.regexp_replace(label.cast("string"), r"[^\p{L}]", "")), 1, 2)
    return F.when(letters != "", letters)


def language_profile(docs: DataFrame, id_col: str, text: str, lang: str, sample: int = SAMPLE) -> Profile:
    """The profile of at most ``sample`` labelled records, taken in the order of a hash.

    For each language of at least one record in a thousand the words that most of its records hold; labels may
    be wrong in part, as a word counts by its share. Without labels there is no profile.
    """
    label = _code(F.col(lang)).alias("_label")
    some = common.durable(common.sampled(docs.select(id_col, label).filter("_label is not null"), id_col, sample))
    sizes = {r["_label"]: r["n"] for r in some.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "_label").limit(LANGUAGES).collect()}
    names = sorted(k for k, n in sizes.items() if n * 1000 >= sum(sizes.values()))
    held = term_counts(docs.select(id_col, text).join(F.broadcast(some), id_col), ["_label"], text).groupBy("_label", "term").agg(F.count(F.lit(1)).alias("n"))
    held = common.durable(held.filter(F.col("_label").isin(names)))
    place = F.row_number().over(Window.partitionBy("_label").orderBy(F.col("n").desc(), "term"))
    words = held.withColumn("_p", place).filter(F.col("_p") <= PROFILE_WORDS).select("term").distinct()
    counts = {(r["term"], r["_label"]): r["n"] for r in held.join(F.broadcast(words), "term").collect()}
    order = sorted({t for t, _ in counts})
    logs = np.array([[math.log((counts.get((t, k), 0) + 0.5) / (sizes[k] + 1.0)) for k in names] for t in order]).reshape(len(order), len(names))
    return Profile(order, names, logs)


class _Store:
    """A DuckDB database on the worker's scratch disk, with a small memory limit: what does not fit is spilled."""

    def __init__(self, memory: str, local: bool) -> None:
        import duckdb

        self.dir = tempfile.mkdtemp(prefix="radix-", dir=common.scratch_parent(local))
        self.con = duckdb.connect(f"{self.dir}/terms.db", config={"threads": 1, "memory_limit": memory, "temp_directory": self.dir, "preserve_insertion_order": False})

    def __enter__(self) -> Any:
        return self.con

    def __exit__(self, *_: object) -> None:
        self.con.close()
        shutil.rmtree(self.dir, ignore_errors=True)


_BOTH = ["document_frequency", "occurrences"]


def _map_side(flush_rows: int, profile: Profile | None):
    """Aggregate what a map task sees, so that the shuffle holds one row per task, term and stripe; the records with a term are counted as ``EVERY``."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["term", "stripe"]).aggregate([(x, "sum") for x in _BOTH]).rename_columns(["term", "stripe", *_BOTH])

    def part_of(batch: pa.RecordBatch) -> pa.Table:
        found = _counted(batch)
        stripe = batch.column(batch.schema.get_field_index("stripe"))
        if profile is not None:
            stripe = profile.of(found, batch.num_rows, stripe)
        d = found["d"].combine_chunks()
        terms = pa.table({"term": found["term"], "stripe": stripe.take(d), "occurrences": found["tf"]}).group_by(["term", "stripe"]).aggregate([("occurrences", "count"), ("occurrences", "sum")])
        worded = pa.array(np.unique(np.asarray(d)))
        every = pa.table({"stripe": stripe.take(worded)}).group_by(["stripe"]).aggregate([([], "count_all")]).rename_columns(["stripe", "n"])
        more = pa.table({"term": pa.array([EVERY] * every.num_rows, pa.string()), "stripe": every["stripe"], "document_frequency": every["n"], "occurrences": every["n"]})
        return pa.concat_tables([terms.select(["term", "stripe", "occurrences_count", "occurrences_sum"]).rename_columns(["term", "stripe", *_BOTH]), more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(part_of(batch))
            rows += held[-1].num_rows
            if rows > flush_rows:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > flush_rows // 2:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=65_536)
                    rows = 0
        if held:
            yield from merged(held).combine_chunks().to_batches(max_chunksize=65_536)

    return run


def _radix_merge(memory: str, split_rows: int, bits: int, local: bool):
    """Aggregate one radix partition out of core; a partition over ``split_rows`` is split by its next hash bits, again and again."""

    def emit(con: Any, name: str) -> Iterator[pa.RecordBatch]:
        reader = con.execute(f"""
            SELECT term, sum(df)::BIGINT AS document_frequency, sum(occ)::BIGINT AS occurrences,
                   list({{'stripe': stripe, 'document_frequency': df, 'occurrences': occ}} ORDER BY stripe) AS stripes
            FROM (SELECT term, stripe, sum(document_frequency)::BIGINT AS df, sum(occurrences)::BIGINT AS occ FROM {name} GROUP BY ALL)
            GROUP BY term""").to_arrow_reader(65_536)
        yield from reader

    def descend(con: Any, name: str, level: int) -> Iterator[pa.RecordBatch]:
        rows = con.execute(f"SELECT count(*) FROM {name}").fetchone()[0]
        if not rows:
            con.execute(f"DROP TABLE {name}")
            return
        if rows <= split_rows or level * bits >= 56:
            yield from emit(con, name)
            con.execute(f"DROP TABLE {name}")
            return
        ways = 1 << bits
        for way in range(ways):
            con.execute(f"CREATE TABLE {name}_{way} AS SELECT * FROM {name} WHERE (hash(term) >> {level * bits}) & {ways - 1} = {way}")
        con.execute(f"DROP TABLE {name}")
        for way in range(ways):
            yield from descend(con, f"{name}_{way}", level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Store(memory, local) as con:
            con.execute("CREATE TABLE part (term VARCHAR, stripe VARCHAR, document_frequency BIGINT, occurrences BIGINT)")
            for batch in batches:
                if batch.num_rows:
                    con.register("incoming", pa.Table.from_batches([batch]))
                    con.execute("INSERT INTO part SELECT term, stripe, document_frequency, occurrences FROM incoming")
                    con.unregister("incoming")
            yield from descend(con, "part", 0)

    return run


def term_statistics(
    docs: DataFrame, text: str = "text", stripe: str = "stripe", partitions: int | None = None, memory: str = "256MB", split_rows: int = SPLIT_ROWS, flush_rows: int = FLUSH_ROWS, bits: int = RADIX_BITS, profile: Profile | None = None
) -> DataFrame:
    """Document frequency and occurrences of every distinct term, over all records and per stripe.

    Recursive radix spilling: terms are cut in the JVM, counted per record and combined per map task, sent to
    partitions by bits of the term's hash, and aggregated there out of core in DuckDB; an oversized partition is
    split by further hash bits first. However often a term occurs, a map task sends it once per stripe, so no
    partition is hot. With a ``profile`` the stripes are the languages it finds, ``stripe`` being the label.

    Every record counts once per term it holds, equal texts too. Null, empty, blank and unworded texts hold no
    term; records without a stripe count globally and under the null stripe. The records with a term are counted in
    the same pass, as a row of the empty term. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    src = docs.select(F.col(stripe).cast("string").alias("stripe"), common.terms(text).alias("terms"))
    partial = src.mapInArrow(_map_side(flush_rows, profile), _BASIC)
    radix = partial.repartition(partitions, "term") if partitions else partial.repartition("term")
    return radix.mapInArrow(_radix_merge(memory, split_rows, bits, common.is_local(docs)), _STATS)


def split(stats: DataFrame) -> tuple[DataFrame, dict[str | None, int]]:
    """(statistics of the terms, records with a term by stripe): the statistics are written once to the shared folder.

    The stripes of the one row that counts records come to the driver; stripes and languages are few.
    """
    held = common.durable(stats)
    every = held.filter(F.col("term") == EVERY).select(F.explode("stripes").alias("s")).select("s.stripe", "s.document_frequency").collect()
    return held.filter(F.col("term") != EVERY), {r["stripe"]: r["document_frequency"] for r in every}


def marked(stats: DataFrame, n: int, rare: int = RARE_AT_MOST, common_over: float = COMMON_OVER) -> DataFrame:
    """Add ``mark``: 'rare' up to ``rare`` records, 'common' over that share of the ``n`` worded records, else null.

    Where both hold (a tiny collection) a term is 'rare'.
    """
    df = F.col("document_frequency")
    return stats.withColumn("mark", F.when(df <= rare, "rare").when(df > round(n * common_over, 6), "common"))


def expected(stripes: Column, records: dict[str | None, int]) -> Column:
    """How many records a term would be in, if its occurrences were spread over the records of each stripe by Poisson's law."""
    known = F.create_map(*[x for k, n in records.items() for x in (F.lit(k or ""), F.lit(float(n)))]) if records else F.lit(None).cast("map<string,double>")

    def add(total: Column, s: Column) -> Column:
        n = known[F.coalesce(s["stripe"], F.lit(""))]
        return total - n * F.expm1(-s["occurrences"] / n)

    return F.aggregate(stripes, F.lit(0.0), add)


def weight(tf: Column, df: Column, would: Column) -> Column:
    """How characteristic a term is of a record: (1 + ln tf) x residual IDF, in bits.

    Residual IDF is the observed inverse document frequency minus the one that the Poisson spread would have.
    """
    return F.round((F.lit(1.0) + F.log(tf.cast("double"))) * F.log2(would / df), 9)


def _cut(stats: DataFrame, at_most: int) -> int:
    """The least power of two that no more than ``at_most`` terms exceed in document frequency; 0 where there are no more terms at all."""
    sizes = {r["b"]: r["n"] for r in stats.groupBy(F.ceil(F.log2("document_frequency")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    above, cut = 0, 0
    for b in sorted(sizes, reverse=True):
        above += sizes[b]
        if above > at_most:
            return 1 << b
    return cut


def term_weights(docs: DataFrame, of: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang", hot_terms: int = HOT_TERMS, sample: int = SAMPLE) -> DataFrame:
    """Weight of every term of the records ``of``, against all records ``docs``: (id, term, tf, document_frequency, occurrences, weight).

    The Poisson expectation is made inside each language, as in a collection of several the function words of a smaller
    one would else be as concentrated as topic words. A record's language is told by a profile of common words,
    fitted to at most ``sample`` labelled records, else by its label in ``lang``; without that column there is one.

    Texts are read once for the statistics and once for the postings of ``of``; what is read twice afterwards is
    written to the shared folder. The statistics of the ``hot_terms`` most frequent terms are broadcast, the others, none of which has a hot
    key, are joined by shuffle. Records without terms give no rows; repeated ids in ``of`` are not merged here.
    """
    profile = language_profile(docs, id_col, text, lang, sample) if lang else None
    labelled = docs.select(text, (_code(F.col(lang)) if lang else F.lit(None).cast("string")).alias("stripe"))
    terms, records = split(term_statistics(labelled, text, profile=profile))
    stats = terms.select("term", "document_frequency", "occurrences", expected(F.col("stripes"), records).alias("_would"))
    postings = term_counts(of, [id_col], text)
    cut = _cut(terms, hot_terms)
    hot, cold = F.col("document_frequency") > cut, F.col("document_frequency") <= cut
    few = F.broadcast(stats.filter(hot))
    if cut:
        postings = common.durable(postings)  # both joins read it
    both = postings.join(few, "term")
    if cut:
        both = both.unionByName(postings.join(few.select("term"), "term", "left_anti").join(stats.filter(cold), "term"))
    return both.select(id_col, "term", "tf", "document_frequency", "occurrences", weight(F.col("tf"), F.col("document_frequency"), F.col("_would")).alias("weight"))


def most_characteristic(weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The one term of highest weight per record; equal weights go to the term that sorts first."""
    w = Window.partitionBy(id_col).orderBy(F.col("weight").desc(), F.col("term"))
    return weights.withColumn("_place", F.row_number().over(w)).filter("_place = 1").select(id_col, "term")
