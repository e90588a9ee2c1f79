"""Corpus statistics: document frequencies and mean lengths, over everything and per stripe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import idf, tokenize
from ..spec import CorpusSpec, Split

# The bands of document frequency in which divergence is reported.
BANDS = (40, 60, 100, 200, 400, 800, 1500)


def tokenized(corpus: DataFrame, spec: CorpusSpec = CorpusSpec(), stop: bool = True) -> DataFrame:
    """(id, stripe, tokens, doc_len); the text columns are read as one text."""
    text = F.concat_ws(" ", *spec.text_cols)
    return corpus.select(F.col(spec.id_col).alias("doc_id"), F.col(spec.stripe_col).alias("stripe"), tokenize(text, stop).alias("tokens")).withColumn("doc_len", F.size("tokens"))


def df_local(tokens: DataFrame) -> DataFrame:
    """Documents of each stripe that hold a term. Equal (stripe, term) rows are combined before the shuffle."""
    return tokens.select("stripe", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("stripe", "term").agg(F.count(F.lit(1)).alias("df"))


def df_global(local: DataFrame) -> DataFrame:
    """Document frequencies over all stripes: sums of the local ones, without a second pass over the texts."""
    return local.groupBy("term").agg(F.sum("df").alias("df"))


def df_rollup(tokens: DataFrame) -> DataFrame:
    """Global and local document frequencies in one pass; the global rows have scope ``all``."""
    terms = tokens.select("stripe", F.explode(F.array_distinct("tokens")).alias("term"))
    sums = terms.groupingSets([["term", "stripe"], ["term"]], "term", "stripe").agg(F.grouping("stripe").alias("g"), F.count(F.lit(1)).alias("df"))
    return sums.select("term", F.when(F.col("g") == 1, "all").otherwise(F.col("stripe")).alias("scope"), "df")


def sizes(tokens: DataFrame) -> DataFrame:
    """Documents and mean length per stripe."""
    return tokens.groupBy("stripe").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


def global_size(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


def build(corpus: DataFrame, spec: CorpusSpec, split: Split) -> dict[str, DataFrame]:
    """The statistics as four tables, each stamped with the split's name."""
    return tables_of(tokenized(corpus, spec), split)


def tables_of(tokens: DataFrame, split: Split) -> dict[str, DataFrame]:
    local = df_local(tokens)
    tables = {"global": global_size(tokens), "stripe": sizes(tokens), "df_global": df_global(local), "df_local": local}
    return {k: v.withColumn("split", F.lit(split.name)) for k, v in tables.items()}


def _side_by_side(tokens: DataFrame, a: str, b: str) -> DataFrame:
    n = {r["stripe"]: r["n_docs"] for r in sizes(tokens).collect()}
    only = lambda s: F.coalesce(F.sum(F.when(F.col("stripe") == s, F.col("df"))), F.lit(0))
    both = df_local(tokens).groupBy("term").agg(F.sum("df").alias("df"), only(a).alias("df_a"), only(b).alias("df_b"))
    weight = lambda c, s: idf(F.col(c), F.lit(n.get(s, 0)))
    return both.withColumn("idf_a", weight("df_a", a)).withColumn("idf_b", weight("df_b", b)).withColumn("gap", F.round(F.abs(F.col("idf_a") - F.col("idf_b")), 9))


def idf_divergence(tokens: DataFrame, a: str, b: str, least: int = 40, top: int = 10) -> DataFrame:
    """The terms whose weight differs most between two stripes, among those in ``least`` documents or more."""
    return _side_by_side(tokens, a, b).filter(F.col("df") >= least).orderBy(F.col("gap").desc(), "term").limit(top)


def band_of(df: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in zip(BANDS, (*BANDS[1:], None)):
        label = f"{low}-{high - 1}" if high else f"{low}+"
        out = F.when((df >= low) & ((df < high) if high else F.lit(True)), label).otherwise(out)
    return out


def band_decay(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Mean weight gap by band of document frequency."""
    rows = _side_by_side(tokens, a, b).withColumn("band", band_of(F.col("df"))).filter("band is not null")
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("terms"), F.avg("gap").alias("mean_gap"))


def imbalance(tokens: DataFrame) -> DataFrame:
    """How unequal the stripes are: ratio of sizes, the weight gap it predicts, and the difference of mean lengths in percent."""
    s = sizes(tokens)
    return s.agg(
        (F.max("n_docs") / F.min("n_docs")).alias("size_ratio"),
        F.log(F.max("n_docs") / F.min("n_docs")).alias("predicted_gap"),
        ((F.max("avgdl") - F.min("avgdl")) / F.min("avgdl") * 100.0).alias("length_gap_percent"),
    )
