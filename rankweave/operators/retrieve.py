"""Retrieval of candidates from the corpus: keyword, vector, hybrid and semantic legs, many queries at once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25, idf, tokenize
from ..session import durable

#: Query vectors, and vectors of the corpus, that one task multiplies.
QUERY_BLOCK, CORPUS_BLOCK = 4096, 32_768
#: Similarities that a task holds at once.
CELLS = 4_000_000
#: Rows about query terms up to this number are broadcast to the postings; more are joined by shuffle.
FEW_TERMS = 500_000
#: Queries, and documents of the corpus, whose postings one task adds up.
TEXT_QUERIES, TEXT_BLOCK = 8192, 131_072
#: Results that the second-stage scorer looks at per index.
SEMANTIC_DEPTH = 50


def terms_of(queries: DataFrame, stop: bool = True) -> DataFrame:
    """(query_id, term): the distinct terms of each query; a query of stop words has none."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize("text", stop))).alias("term"))


def postings(tokens: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, stripe, doc_len, term, tf) of every term, and for each document one row with the empty term.

    Documents are cut into ``partitions`` by id before their terms are counted, so each is counted where it is and
    later joins and sums by document need no further shuffle.
    """
    rows = tokens.repartition(partitions, "doc_id").select("doc_id", "stripe", "doc_len", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    return rows.groupBy("doc_id", "stripe", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def matching(index: DataFrame, qterms: DataFrame) -> DataFrame:
    """The postings of the queries' terms."""
    return index.join(_few(qterms.select("term").distinct()), "term", "left_semi")


def _few(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(FEW_TERMS + 1).count() <= FEW_TERMS else rows


def probe(near: DataFrame) -> DataFrame:
    """(stripe, term, df) counted on the fly from the postings of the queries' terms."""
    return near.groupBy("stripe", "term").agg(F.count(F.lit(1)).alias("df"))


def budget(stripes: int, equalized: bool = True, size: int = 50) -> int:
    """Candidates per stripe: together as many as the un-split index returns, or as many from each."""
    return math.ceil(size / max(stripes, 1)) if equalized else size


def positions(stripe: Column, order: list[str]) -> Column:
    out = F.lit(len(order))
    for i, s in enumerate(order):
        out = F.when(stripe == s, i).otherwise(out)
    return out.cast("int")


def lists(near: DataFrame, qterms: DataFrame, df: DataFrame, size: DataFrame, whole: tuple[DataFrame, DataFrame] | None = None, top: int = 50, k1: float = 1.2, b: float = 0.75, query_block: int = TEXT_QUERIES, corpus_block: int = TEXT_BLOCK) -> DataFrame:
    """BM25 per stripe with the stripe's own statistics: what an index returns by itself, one row per query and stripe.

    ``near`` holds the postings of the queries' terms. A posting is weighted once, whichever and however many queries
    ask for it. Documents and queries are cut into blocks; a task adds up the postings of one block of each, query by
    query in one array over its documents, so the sums of all matching pairs are never rows, and neither side is ever
    whole in one place. Only the best ``top`` of each pair of blocks are sent on.

    The hits of a row, best first, are arrays of equal length: doc_id, doc_len, score, ``held`` (how many of the query's
    ``need`` terms a hit holds), ``whole`` (BM25 with the corpus-wide statistics ``whole``: document frequencies and
    size) and, if ``near`` has it, the ``home`` of the document.
    """
    stats = df.join(F.broadcast(size), "stripe")
    part = bm25(idf(F.col("df"), F.col("n_docs")), F.col("tf").cast("double"), F.col("doc_len"), F.col("avgdl"), k1, b)
    wide_part = part
    if whole is not None:
        stats = stats.join(whole[0].select("term", F.col("df").alias("_df")), "term").withColumn("_n", whole[1].select("n_docs").scalar()).withColumn("_avg", whole[1].select("avgdl").scalar())
        wide_part = bm25(idf(F.col("_df"), F.col("_n")), F.col("tf").cast("double"), F.col("doc_len"), F.col("_avg"), k1, b)
    docs, n = size.agg(F.sum("n_docs")).first()[0] or 0, qterms.select("query_id").distinct().count()
    long, wide = max(1, math.ceil(docs / corpus_block)), max(1, math.ceil(n / query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    home = ["home"] if "home" in near.columns else []
    of_doc, of_term = ["doc_id", "doc_len", *home], ["doc_id", "own", "whole"]
    here = near.withColumn("_c", place("doc_id", long))
    packed = lambda rows, keys, cols: rows.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_p"))
    given = lambda name, cols: (F.col(f"_p.{name}") if name in cols else F.lit(None).cast(f"array<{kind[name]}>")).alias(name)
    kind = {"doc_id": near.schema["doc_id"].dataType.simpleString(), "doc_len": "int", "own": "double", "whole": "double", "home": "string"}
    names = ["doc_id", "doc_len", "own", "whole", *home]
    known = packed(here.select("_c", "stripe", *of_doc).distinct(), ["_c", "stripe"], of_doc)
    weighted = here.join(_few(stats), ["stripe", "term"]).select("_c", "stripe", "term", "doc_id", part.alias("own"), wide_part.alias("whole"))
    held = packed(weighted, ["_c", "stripe", "term"], of_term)
    left = held.select("_c", "stripe", "term", *[given(x, of_term) for x in names]).unionByName(known.select("_c", "stripe", F.lit(None).cast("string").alias("term"), *[given(x, of_doc) for x in names]))
    right = qterms.groupBy("query_id").agg(F.collect_list("term").alias("terms")).select("query_id", "terms", place("query_id", wide).alias("_q"), every(long).alias("_c"))

    hits = {"doc_id": kind["doc_id"], "doc_len": "int", "score": "double", "held": "int", "whole": "double"} | {x: "string" for x in home}
    kinds = f"query_id {qterms.schema['query_id'].dataType.simpleString()}, stripe string, need int, " + ", ".join(f"{x} array<{t}>" for x, t in hits.items())
    found = left.withColumn("_q", every(wide)).groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(_heaviest(top), kinds)
    if long == 1:
        return found
    both = found.groupBy("query_id", "stripe").agg(F.first("need").alias("need"), F.flatten(F.collect_list(F.arrays_zip(*hits))).alias("_h"))
    order = F.transform("_h", lambda h: F.struct((-h["score"]).alias("_s"), h["doc_id"].alias("_d"), h.alias("h")))
    best = both.withColumn("_h", F.slice(F.array_sort(order), 1, top))
    return best.select("query_id", "stripe", "need", *[F.col(f"_h.h.{x}").alias(x) for x in hits])


def opened(found: DataFrame, order: list[str] = ["a", "b"]) -> DataFrame:
    """The hits of the lists as rows with 1-based ranks; a list's rows stay where the list is."""
    inside = [x for x in found.columns if x not in ("query_id", "stripe", "need")]
    rows = found.select("query_id", "stripe", "need", F.posexplode(F.arrays_zip(*inside)).alias("_i", "_h"))
    hits = rows.select("query_id", "stripe", *[F.col(f"_h.{x}").alias(x) for x in inside], "need", (F.col("_i") + 1).alias("hit_rank"))
    return hits.withColumn("mode", F.lit("Keyword")).withColumn("stripe_pos", positions(F.col("stripe"), order)).withColumn("text_score", F.col("score"))


def keyword(near: DataFrame, qterms: DataFrame, df: DataFrame, size: DataFrame, top: int = 50, order: list[str] = ["a", "b"], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The hits of ``lists`` as rows."""
    return opened(lists(near, qterms, df, size, None, top, k1, b), order)


def _arrays(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of a column's arrays, and their values."""
    column = table.column(name).combine_chunks()
    return np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of some runs, one run after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


#: Scores this near to the last one that is kept are looked at again after rounding.
SLACK = 1e-8


def _sums(weights: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, float]], sums: np.ndarray, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """The documents that can be among a query's best, and their scores: added up over its terms in ``sums``.

    Where no weight is below 0, no document under the ``top``-th best weight of one term can be among the best.
    """
    if len(weights) == 1:
        return weights[0][0], weights[0][1]
    sums.fill(0.0)
    for at, own, row, _ in weights:
        if row is None:
            sums[at] += own
        else:
            sums += row
    least = max(x[3] for x in weights) - SLACK
    near = np.flatnonzero(sums >= least) if least > 0 and not signed else np.unique(np.concatenate([x[0] for x in weights]))
    return near, sums[near]


def _heaviest(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        home = "home" in postings.column_names
        parts: list[list[pa.Array]] = []
        own_kind, doc_kind = asked.schema.field("query_id").type, postings.schema.field("doc_id").type.value_type
        fields = {"doc_id": doc_kind, "doc_len": pa.int32(), "score": pa.float64(), "held": pa.int32(), "whole": pa.float64()} | ({"home": pa.string()} if home else {})
        kinds = [own_kind, pa.string(), pa.int32(), *[pa.list_(t) for t in fields.values()]]
        if postings.num_rows and asked.num_rows:
            cols = {x: _arrays(postings, x) for x in ("doc_id", "doc_len", "own", "whole", *(["home"] if home else []))}
            cut = lambda x, i: cols[x][1][cols[x][0][i] : cols[x][0][i + 1]]
            rows: dict[str, dict[str | None, int]] = {}
            for i, (stripe, term) in enumerate(zip(postings["stripe"].to_pylist(), postings["term"].to_pylist())):
                rows.setdefault(stripe, {})[term] = i
            queries, wanted = asked["query_id"].combine_chunks(), asked["terms"].to_pylist()
            need = np.array([len(x) for x in wanted])
            for stripe, at in rows.items():
                ids = cut("doc_id", at[None])
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                terms, wide = {}, {}
                for term, i in at.items():
                    if term is None:
                        continue
                    place = np.searchsorted(ids, cut("doc_id", i))
                    o = np.argsort(place)
                    place, own = place[o], cut("own", i)[o]
                    row = None
                    if len(place) * 4 > len(ids):
                        row = np.zeros(len(ids))
                        row[place] = own
                    terms[term] = place, own, row, float(np.partition(own, len(own) - top)[len(own) - top]) if len(own) >= top else 0.0
                    wide[term] = cut("whole", i)[o]
                signed = any(x[1].min() < 0 for x in terms.values())
                # queries of the same terms have the same list
                sets: dict[tuple[str, ...], int] = {}
                of_query = np.array([sets.setdefault(tuple(sorted(t for t in x if t in terms)), len(sets)) for x in wanted])
                sums, found, scores, askers = np.zeros(len(ids)), [], [], {}
                for k, known in enumerate(sets):
                    if not known:
                        found.append(np.zeros(0, dtype=np.int64))
                        scores.append(np.zeros(0))
                        continue
                    near, value = _sums([terms[t] for t in known], sums, signed)
                    if len(near) > top:
                        good = np.flatnonzero(value >= np.partition(value, len(value) - top)[len(value) - top] - SLACK)
                        near, value = near[good], value[good]
                    value = np.round(value, 9)
                    best = np.argsort(-value, kind="stable")[:top]  # equal ones stay in the order of their ids
                    found.append(near[best])
                    scores.append(value[best])
                    for t in known:
                        askers.setdefault(t, []).append(k)
                counts = np.array([len(x) for x in found])
                starts, place, score = np.cumsum(counts) - counts, np.concatenate(found), np.concatenate(scores)
                held, whole = np.zeros(len(place), dtype=np.int32), np.zeros(len(place))
                for t, ks in askers.items():
                    hits = _spread(starts[ks], counts[ks])
                    own = terms[t][0]
                    j = np.minimum(np.searchsorted(own, place[hits]), len(own) - 1)
                    same = own[j] == place[hits]
                    held[hits] += same
                    whole[hits] += np.where(same, wide[t][j], 0.0)
                listed = np.flatnonzero(counts[of_query] > 0)
                n = counts[of_query[listed]]
                hits = _spread(starts[of_query[listed]], n)
                bounds = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                of_doc = lambda x: cut(x, at[None])[order][place[hits]]
                values = [ids[place[hits]], of_doc("doc_len"), score[hits], held[hits], whole[hits], *([of_doc("home")] if home else [])]
                own = [queries.take(pa.array(listed)), pa.array([stripe] * len(listed), pa.string()), pa.array(need[listed], pa.int32())]
                parts.append(own + [pa.ListArray.from_arrays(bounds, pa.array(v, t)) for v, t in zip(values, fields.values())])
        names = ["query_id", "stripe", "need", *fields]
        return pa.concat_tables([pa.table(x, names=names) for x in parts] or [pa.table([pa.array([], t) for t in kinds], names=names)])

    return run


def ranked(scored: DataFrame, top: int, mode: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id", "stripe").orderBy(F.col("score").desc(), F.col("doc_id"))
    best = scored.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= top)
    return best.withColumn("mode", F.lit(mode)).withColumn("stripe_pos", positions(F.col("stripe"), order))


def vector(corpus: DataFrame, queries: DataFrame, top: int = 50, order: list[str] = ["a", "b"], where: Column | None = None, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Exact nearest neighbours by cosine: (query_id, stripe, doc_id, score, hit_rank, ...).

    ``queries`` (query_id, embedding) is the stated query set. Queries and corpus are cut into blocks by a hash of the
    id, and a task multiplies one block of each, so neither side is ever whole in one place; it gives the best
    ``top`` of its pair of blocks for each query and stripe. A missing query vector is an error; documents
    without a vector or with a zero vector are not found, nor is anything for a zero query vector.
    """
    src = corpus.filter(where) if where is not None else corpus
    src = src.filter(F.col("embedding").isNotNull()).select("doc_id", "stripe", "embedding")
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("m")).first()
    if asked["n"] > asked["m"]:
        raise ValueError("a vector query needs a vector")
    wide = max(1, math.ceil(asked["n"] / query_block))
    long = max(1, math.ceil(src.count() / corpus_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = src.select("doc_id", "stripe", _doubles("embedding"), place("doc_id", long).alias("_c"), every(wide).alias("_q"))
    right = queries.select("query_id", _doubles("embedding"), place("query_id", wide).alias("_q"), every(long).alias("_c"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, stripe string, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"
    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(_nearest(top), kinds)
    return ranked(found, top, "Vector", order).withColumn("vector_similarity", F.col("score"))


def _doubles(name: str) -> Column:
    return F.col(name).cast("array<double>").alias(name)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a table as unit rows, and which of them have a length."""
    column = table.column("embedding").combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length > 0, length, 1.0)[:, None], length > 0


def _nearest(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "stripe": [], "doc_id": [], "score": []}
        if docs.num_rows and asked.num_rows:
            own, good = _matrix(docs)
            matrix, fit = _matrix(asked)
            ids, names = np.asarray(docs["doc_id"]), np.asarray(docs["stripe"].to_pylist(), dtype=object)
            queries = asked["query_id"].to_pylist()
            for stripe in dict.fromkeys(names):
                at = np.flatnonzero(good & (names == stripe))
                at = at[np.argsort(ids[at], kind="stable")]
                if not len(at):
                    continue
                step = max(1, CELLS // len(at))
                for i in range(0, len(queries), step):
                    sims = np.round(matrix[i : i + step] @ own[at].T, 9)
                    for j in np.flatnonzero(fit[i : i + step]):
                        row = sims[j]
                        near = np.flatnonzero(row >= -np.partition(-row, top - 1)[top - 1]) if len(row) > top else np.arange(len(row))
                        best = near[np.argsort(-row[near], kind="stable")][:top]  # equal ones stay in the order of their ids
                        out["query_id"] += [queries[i + j]] * len(best)
                        out["stripe"] += [stripe] * len(best)
                        out["doc_id"] += ids[at[best]].tolist()
                        out["score"] += row[best].tolist()
        kinds = [asked.schema.field("query_id").type, pa.string(), docs.schema.field("doc_id").type, pa.float64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def hybrid(text_leg: DataFrame, vector_leg: DataFrame, top: int = 50, order: list[str] = ["a", "b"], k: int = 60) -> DataFrame:
    """Both legs joined by reciprocal rank; the legs' own scores stay visible and are null where a leg did not find the document."""
    t = text_leg.select("query_id", "stripe", "doc_id", F.col("score").alias("text_score"), F.col("hit_rank").alias("_t"))
    v = vector_leg.select("query_id", "stripe", "doc_id", F.col("score").alias("vector_similarity"), F.col("hit_rank").alias("_v"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = t.join(v, ["query_id", "stripe", "doc_id"], "full").withColumn("score", F.round(share("_t") + share("_v"), 9))
    return ranked(both.drop("_t", "_v"), top, "Hybrid", order)


def semantic(candidates: DataFrame, near: DataFrame, qterms: DataFrame, depth: int = SEMANTIC_DEPTH) -> DataFrame:
    """Add ``reranker_score`` (0 to 4) for the first ``depth`` candidates of an index, null beyond.

    The scorer is a stand-in for a cross-encoder: four times the share of the query's terms that the document
    holds, which a keyword search has counted (``held`` of ``need``) and which is looked up in the postings for other hits. Like
    the real one it does not depend on the corpus.
    """
    score = lambda held, need: F.when((F.col("hit_rank") <= depth) & (F.col(need) > 0), F.round(F.lit(4.0) * F.coalesce(held, F.lit(0)) / F.col(need), 9))
    if "held" in candidates.columns:
        return candidates.withColumn("reranker_score", score("held", "need"))
    need = qterms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    seen = candidates.filter(F.col("hit_rank") <= depth).select("query_id", "doc_id").distinct()
    held = seen.join(qterms, "query_id").join(near.select("doc_id", "term"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_h"))
    joined = candidates.join(held, ["query_id", "doc_id"], "left").join(need, "query_id", "left")
    return joined.withColumn("reranker_score", score("_h", "_n")).drop("_h", "_n")


def answered(stripes: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """(hits, failures): the hits of every stripe whose search succeeds, and the message of each that fails.

    Each stripe is searched and its hits are written apart, so a stripe that cannot be read or fails while it is searched
    costs its own hits only. No stripe at all, or none that answers, is an error.
    """
    hits, failures = None, {}
    for name, search in stripes.items():
        try:
            part = durable(search())
        except Exception as e:  # whatever a source or a scorer raises
            failures[name] = str(e).strip().split("\n")[0]
            continue
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        raise RuntimeError(f"no stripe answered: {failures}")
    return hits, failures


def counts(corpus: DataFrame) -> DataFrame:
    """Documents per index."""
    return corpus.groupBy("stripe").agg(F.count(F.lit(1)).alias("n_docs"))
