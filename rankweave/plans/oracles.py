"""SQL of the registered queries, for a second engine to run on the same tables."""

from __future__ import annotations

from ..functions.labels import CATEGORIES
from ..functions.statistics import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_LOW, ERF_A, ERF_P
from ..functions.text import STOP_WORDS
from ..operators.corpus_stats import BANDS
from ..operators.significance import ITERATIONS, MIX, SEED
from . import files
from .catalog import STRATEGIES
from .inputs import GENRE_TAGS, LANGUAGE_STRIPES

HALF, ONE = "0.5::DOUBLE", "1::DOUBLE"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def hashed(key: str) -> str:
    return f"CASE WHEN ('0x' || substr(sha256({key}::VARCHAR || ':42'), 1, 2))::INT % 2 = 0 THEN 'a' ELSE 'b' END"


def toks(text: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{Nd}}]{{2,}}')"
    return f"list_filter({found}, lambda x: NOT list_contains({STOP}, x))" if stop else found


LANGUAGE = "CASE WHEN trim(lang) = '' THEN NULL WHEN lower(trim(lang)) LIKE 'en%' THEN 'en' ELSE trim(lang) END"
_GROUPS = " ".join(f"WHEN lower(l) = '{a}' THEN '{b}'" for a, b in LANGUAGE_STRIPES)
_AUTHORS = "au AS (SELECT book_id, array_to_string(list_filter(list_transform(string_split(coalesce(a, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ' ') AS authors FROM (SELECT book_id, arg_max(struct_pack(a := authors), struct_pack(r := received_at, c := ratings_count)).a AS a FROM books WHERE book_id IS NOT NULL GROUP BY book_id))"
CORPUS = f"{_AUTHORS}, corpus AS (SELECT doc_id, title, concat_ws(' ', title, authors, coalesce(text, '')) AS text, l AS language, CASE {_GROUPS} ELSE {hashed('doc_id')} END AS stripe FROM (SELECT *, {LANGUAGE} AS l FROM documents) LEFT JOIN au USING (book_id))"


def token_ctes(stop: bool = True) -> str:
    return f"""{CORPUS},
    tok AS (SELECT doc_id, stripe, {toks('text', stop)} AS tokens FROM corpus),
    tokl AS (SELECT *, len(tokens) AS doc_len FROM tok),
    dfl AS (SELECT stripe, term, count(*) AS df FROM (SELECT stripe, unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY ALL),
    dfg AS (SELECT term, sum(df)::BIGINT AS df FROM dfl GROUP BY ALL),
    sz AS (SELECT stripe, count(*) AS n_docs, avg(doc_len) AS avgdl FROM tokl GROUP BY ALL),
    gsz AS (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM tokl)"""


def idf(df: str, n: str) -> str:
    return f"ln({ONE} + ({n} - {df} + {HALF}) / ({df} + {HALF}))"


def bm25(df: str, n: str, tf: str, dl: str, avg: str) -> str:
    k, b = "1.2::DOUBLE", "0.75::DOUBLE"
    return f"{idf(df, n)} * {tf} * ({k} + 1) / ({tf} + {k} * ({ONE} - {b} + {b} * {dl} / {avg}))"


def values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


#: Every evaluation query with the last text delivered for it, and the stated query set.
EVALUATED = "q AS (SELECT query_id, arg_max(text, struct_pack(r := received_at, t := text)) AS text FROM eval_queries WHERE query_id IS NOT NULL GROUP BY ALL)"


STATED = EVALUATED.replace("q AS", "q0 AS") + ", q AS (SELECT * FROM q0 WHERE TRY_CAST(regexp_extract(query_id, '\\d+') AS BIGINT) % 50 = 0)"


def retrieval(stop: bool = True, asked: str = STATED) -> str:
    return f"""{token_ctes(stop)},
    {asked},
    qt AS (SELECT query_id, unnest(list_distinct({toks('text', stop)})) AS term FROM q),
    post AS (SELECT doc_id, stripe, doc_len, term, count(*) AS tf FROM (SELECT doc_id, stripe, doc_len, unnest(tokens) AS term FROM tokl) GROUP BY ALL),
    tf AS (SELECT query_id, stripe, doc_id, doc_len, post.term, tf FROM post JOIN qt ON post.term = qt.term),
    kws AS (SELECT query_id, stripe, doc_id, round(sum({bm25('df', 'n_docs', 'tf', 'doc_len', 'avgdl')}), 9) AS score FROM tf JOIN dfl USING (stripe, term) JOIN sz USING (stripe) GROUP BY ALL),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query_id, stripe ORDER BY score DESC, doc_id) AS hit_rank, CASE stripe WHEN 'a' THEN 0 ELSE 1 END AS stripe_pos, 'Keyword' AS mode FROM kws),
    nt AS (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL),
    held AS (SELECT query_id, doc_id, count(*) AS h FROM (SELECT DISTINCT query_id, doc_id, term FROM tf) GROUP BY ALL),
    kwr AS (SELECT kw.*, score AS text_score, NULL::DOUBLE AS vector_similarity, CASE WHEN hit_rank <= 50 THEN round(4 * coalesce(h, 0) / n::DOUBLE, 9) END AS reranker_score FROM kw LEFT JOIN held USING (query_id, doc_id) LEFT JOIN nt USING (query_id)),
    cand AS (SELECT * FROM kwr WHERE hit_rank <= 25),
    wide AS (SELECT * FROM kwr WHERE hit_rank <= 50),
    ors AS (SELECT query_id, doc_id, stripe, round(sum({bm25('dfg.df', 'gsz.n_docs', 'tf', 'doc_len', 'gsz.avgdl')}), 9) AS score FROM tf JOIN dfg ON tf.term = dfg.term, gsz GROUP BY ALL),
    orc AS (SELECT o.*, h.h, 'Keyword' AS mode, 0 AS stripe_pos, score AS text_score, NULL::DOUBLE AS vector_similarity, round(4 * coalesce(h, 0) / n::DOUBLE, 9) AS reranker_score
            FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank FROM ors) WHERE hit_rank <= 50) o LEFT JOIN held h USING (query_id, doc_id) LEFT JOIN nt USING (query_id))"""


_NUM = ", ".join(f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}" for c in ("score", "text_score", "vector_similarity", "reranker_score"))
HITS = f"hits AS (SELECT * FROM (SELECT query_id, mode, stripe, stripe_pos, doc_id, min(hit_rank) AS hit_rank, {_NUM} FROM candidates GROUP BY ALL) WHERE score IS NOT NULL)"


def tail(source: str, k: int = 10, digits: int = 9) -> str:
    return f"""t1 AS (SELECT query_id, mode, doc_id, stripe, stripe_pos, hit_rank, round(fused, {digits}) AS fused_score FROM ({source}) WHERE fused IS NOT NULL),
    t2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode, doc_id ORDER BY fused_score DESC, stripe_pos, hit_rank) AS o FROM t1),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY fused_score DESC, doc_id) AS fused_rank FROM t2 WHERE o = 1)
    SELECT query_id, mode, doc_id, stripe, round(fused_score, {digits}) AS fused_score, fused_rank FROM fused WHERE fused_rank <= {k}"""


def explained(plans: list[tuple[str, str, int, str]], k: int = 10) -> str:
    """The lists of some plans (strategy, its scored hits, decimals, explanation), each hit with its explanation."""
    one = lambda name, source, digits, x: f"""SELECT query_id, mode, '{name}' AS strategy, doc_id, stripe, fused_rank, explanation FROM (WITH t1 AS (SELECT *, round(fused, {digits}) AS fs, {x} AS explanation FROM ({source}) WHERE fused IS NOT NULL),
        t2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode, doc_id ORDER BY fs DESC, stripe_pos, hit_rank) AS o FROM t1) SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY fs DESC, doc_id) AS fused_rank FROM t2 WHERE o = 1) WHERE fused_rank <= {k}"""  # noqa: E731
    return " UNION ALL ".join(one(*p) for p in plans)


def over_hits(fused: str, where: str = "TRUE", joins: str = "", more: str = "", k: int = 10) -> str:
    return f"WITH {HITS}{', ' + more if more else ''}, {tail(f'SELECT h.*, {fused} AS fused FROM hits h {joins} WHERE {where}', k)}"


def over(source: str, fused: str, joins: str = "", more: str = "", k: int = 10, stop: bool = True, where: str = "TRUE", asked: str = STATED) -> str:
    return f"WITH {retrieval(stop, asked)}{', ' + more if more else ''}, {tail(f'SELECT c.*, {fused} AS fused FROM {source} c {joins} WHERE {where}', k)}"


#: Place in the list, then the stripe's place among those that answered.
INTERLEAVED = "-(hit_rank - 1 + nth / n::DOUBLE)"


def answering(hits: str, key: str) -> str:
    return f"st AS (SELECT {key}, stripe_pos, row_number() OVER (PARTITION BY {key} ORDER BY stripe_pos) - 1 AS nth, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, stripe_pos FROM {hits}))"


FACTORS = f"""fac AS (SELECT query_id, stripe, sum(g / l * g) / sum(g) AS factor FROM (
    SELECT query_id, dfl.stripe, {idf('dfg.df', 'gsz.n_docs')} AS g, {idf('dfl.df', 'sz.n_docs')} AS l FROM qt JOIN dfg ON qt.term = dfg.term JOIN dfl ON qt.term = dfl.term JOIN sz ON sz.stripe = dfl.stripe, gsz) WHERE l > 0 GROUP BY ALL)"""
CORRECTED = "CASE WHEN EXISTS (SELECT 1 FROM fac f2 WHERE f2.query_id = c.query_id) THEN coalesce(text_score, score) * coalesce(factor, 1) ELSE score END"
GLOBAL = f"gb AS (SELECT query_id, doc_id, sum({bm25('dfg.df', 'gsz.n_docs', 'tf', 'doc_len', 'gsz.avgdl')}) AS b FROM tf JOIN dfg ON tf.term = dfg.term, gsz GROUP BY ALL)"
LOCAL = f"lb AS (SELECT query_id, doc_id, sum({bm25('dfl.df', 'sz.n_docs', 'tf', 'doc_len', 'sz.avgdl')}) AS b FROM tf JOIN dfl ON tf.term = dfl.term AND tf.stripe = dfl.stripe JOIN sz ON sz.stripe = tf.stripe GROUP BY ALL)"
RESCORED = "coalesce(b, 0)"


def chosen(threshold: float) -> str:
    return f"""yl AS (SELECT query_id, dfl.stripe, round(sum({idf('dfg.df', 'gsz.n_docs')} * dfl.df), 9) AS y FROM qt JOIN dfg ON qt.term = dfg.term JOIN dfl ON dfl.term = qt.term, gsz GROUP BY ALL),
    yg AS (SELECT q.query_id, s.stripe, coalesce(y, 0) AS y FROM q CROSS JOIN (VALUES ('a'), ('b')) s(stripe) LEFT JOIN yl ON yl.query_id = q.query_id AND yl.stripe = s.stripe),
    yk AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY query_id) AS best FROM yg) WHERE best <= 0 OR y >= best * {threshold}::DOUBLE),
    ch AS (SELECT query_id, stripe, count(*) OVER (PARTITION BY query_id) AS chosen FROM yk),
    kept AS (SELECT w.*, chosen FROM wide w JOIN ch USING (query_id, stripe) WHERE hit_rank <= ceil(50 / chosen::DOUBLE)),
    one AS (SELECT query_id, mode, doc_id, stripe, score AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_rank) AS fused_rank FROM kept WHERE chosen = 1)"""


def selective(threshold: float) -> str:
    several = tail(f"SELECT c.*, {RESCORED} AS fused FROM kept c LEFT JOIN gb USING (query_id, doc_id) WHERE chosen > 1")
    head, _, last = several.rpartition("SELECT query_id, mode")
    return f"WITH {retrieval()}, {GLOBAL}, {chosen(threshold)}, {head} SELECT query_id, mode{last} UNION ALL SELECT query_id, mode, doc_id, stripe, round(fused_score, 9), fused_rank FROM one WHERE fused_rank <= 10"


_LEG = lambda c: f"CASE WHEN {c} IS NOT NULL THEN 1 / (60::DOUBLE + row_number() OVER (PARTITION BY query_id, mode ORDER BY {c} DESC NULLS LAST, doc_id, stripe_pos)) END"
_LEGS = f"SELECT *, CASE WHEN t IS NOT NULL OR v IS NOT NULL THEN coalesce(t, 0) + coalesce(v, 0) END AS fused FROM (SELECT *, {_LEG('text_score')} AS t, {_LEG('vector_similarity')} AS v FROM hits WHERE mode = 'Hybrid')"
LEGS = f"WITH {HITS}, {tail(_LEGS)}"

_LISTS = f"""{HITS},
    n1 AS (SELECT query_id, doc_id, stripe, round(score, 12) AS s, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 12) DESC, stripe_pos, hit_rank) AS o FROM hits WHERE mode = 'Hybrid'),
    li AS (SELECT * FROM (SELECT query_id, doc_id, stripe, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM n1 WHERE o = 1) WHERE rank <= 10),
    g1 AS (SELECT query_id, doc_id, max(round(fused, 9)) AS s FROM ({_LEGS}) WHERE fused IS NOT NULL GROUP BY ALL),
    tr AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM g1) WHERE rank <= 50),
    qs AS (SELECT DISTINCT query_id FROM candidates),
    sh AS (SELECT li.query_id, li.doc_id, li.rank AS rc, tr.rank AS ro FROM li JOIN tr USING (query_id, doc_id)),
    ju AS (SELECT query_id, doc_id, least(3, greatest(0, floor(max(vector_similarity) * 4)))::INT AS grade FROM hits WHERE mode = 'Hybrid' AND vector_similarity <= 1 GROUP BY ALL)"""


def lists(body: str) -> str:
    return f"WITH {_LISTS} {body}"


_NDCG = """, dc AS (SELECT query_id, sum(1 / log2(ro + 1) / log2(rc + 1)) AS d FROM sh GROUP BY ALL), id AS (SELECT query_id, sum(1 / log2(rank + 1) / log2(rank + 1)) AS i FROM tr WHERE rank <= 10 GROUP BY ALL)
    SELECT query_id, round(coalesce(d / i, 0), 6) AS ndcg FROM qs LEFT JOIN id USING (query_id) LEFT JOIN dc USING (query_id)"""
_JUDGED = """, bj AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM ju), id AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS i FROM bj WHERE r <= 10 GROUP BY ALL),
    dc AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS d FROM li JOIN ju USING (query_id, doc_id) GROUP BY ALL)
    SELECT query_id, round(CASE WHEN i > 0 THEN coalesce(d, 0) / i ELSE 0 END, 6) AS judged_ndcg FROM qs LEFT JOIN id USING (query_id) LEFT JOIN dc USING (query_id)"""
_OVERLAP = """, c AS (SELECT query_id, count(*) AS na FROM li GROUP BY ALL), t AS (SELECT query_id, count(*) AS nb FROM tr WHERE rank <= 10 GROUP BY ALL), b AS (SELECT query_id, count(*) AS nab FROM sh WHERE ro <= 10 GROUP BY ALL)
    SELECT query_id, round(CASE WHEN nb > 0 THEN coalesce(nab, 0) / nb::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN na IS NULL AND nb IS NULL THEN 1 ELSE coalesce(nab, 0) / (coalesce(na, 0) + coalesce(nb, 0) - coalesce(nab, 0))::DOUBLE END, 6) AS jaccard
    FROM qs LEFT JOIN c USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN b USING (query_id)"""
_KENDALL = """, p AS (SELECT x.query_id, sum(sign(y.ro - x.ro)) / count(*)::DOUBLE AS tau FROM sh x JOIN sh y ON x.query_id = y.query_id AND x.rc < y.rc GROUP BY ALL)
    SELECT query_id, round(coalesce(tau, 0), 6) AS kendall_tau FROM qs LEFT JOIN p USING (query_id)"""
_RBO = """, dp AS (SELECT query_id, max(rank) AS depth FROM (SELECT query_id, rank FROM li UNION ALL SELECT query_id, rank FROM tr WHERE rank <= 10) GROUP BY ALL),
    ov AS (SELECT dp.query_id, depth, d, (SELECT count(*) FROM sh WHERE sh.query_id = dp.query_id AND rc <= d AND ro <= d) AS o FROM dp, range(1, 11) r(d) WHERE d <= depth),
    rb AS (SELECT query_id, (1 - 0.9::DOUBLE) * sum(pow(0.9::DOUBLE, d - 1) * o / d) / (1 - pow(0.9::DOUBLE, max(depth))) AS v FROM ov GROUP BY ALL)
    SELECT query_id, round(coalesce(v, 1), 6) AS rbo FROM qs LEFT JOIN rb USING (query_id)"""
_SAME = """, b AS (SELECT query_id, min((coalesce(l.doc_id = t.doc_id, FALSE))::INT) AS same FROM li l FULL JOIN (SELECT * FROM tr WHERE rank <= 10) t USING (query_id, rank) GROUP BY ALL)
    SELECT query_id, coalesce(same, 1) AS same FROM qs LEFT JOIN b USING (query_id)"""
_COVERAGE = """, c AS (SELECT query_id, avg((ju.doc_id IS NOT NULL)::INT) AS v FROM li LEFT JOIN ju USING (query_id, doc_id) GROUP BY ALL)"""

RECORDS = """rec AS (SELECT record_id, r.* FROM (SELECT record_id, arg_max(struct_pack(run_id := run_id, query_id := query_id, mode := mode, strategy := strategy, latency_ms := CASE WHEN latency_ms > 0 AND NOT isnan(latency_ms) THEN latency_ms END,
    ndcg := ndcg, judged_ndcg := judged_ndcg, compute_units := compute_units, agentic_tokens := agentic_tokens, stripe_mix := stripe_mix), ingested_at) AS r FROM eval_records WHERE record_id IS NOT NULL GROUP BY record_id))"""
SUMMARY = f"""{RECORDS}, su AS (SELECT mode, strategy, count(*) AS queries, avg(ndcg) AS ndcg, avg(judged_ndcg) AS judged_ndcg, avg(compute_units) AS compute_units, avg(agentic_tokens) AS agentic_tokens,
    quantile_disc(latency_ms, 0.5) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) AS latency_p95_ms FROM rec GROUP BY ALL)"""


def differences(value: str = "judged_ndcg", baseline: str = "single-index", where: str = "TRUE") -> str:
    return f"""{RECORDS}, fv AS (SELECT mode, strategy, query_id, arg_min({value}, record_id) AS v FROM rec WHERE {value} IS NOT NULL AND NOT isnan({value}) AND {where} GROUP BY ALL),
    di AS (SELECT a.mode, a.strategy, a.query_id, a.v - b.v AS d FROM fv a JOIN fv b ON a.mode = b.mode AND a.query_id = b.query_id AND b.strategy = '{baseline}' WHERE a.strategy <> '{baseline}')"""


PAIRED = "SELECT mode, strategy, count(*) AS n, round(avg(d), 6) AS mean, sum((d > 0)::INT)::BIGINT AS wins, sum((d < 0)::INT)::BIGINT AS losses, sum((d = 0)::INT)::BIGINT AS ties FROM di GROUP BY ALL"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf(x: str) -> str:
    t = f"(1 / (1 + {ERF_P!r}::DOUBLE * abs({x} / sqrt(2::DOUBLE))))"
    return f"(0.5::DOUBLE * (1 + sign({x}) * (1 - {horner(t, tuple(reversed(ERF_A)))} * {t} * exp(-({x} * {x}) / 2))))"


def normal_quantile(p: str) -> str:
    tail_of = lambda q: f"{horner(q, ACKLAM_C)} / ({horner(q, ACKLAM_D)} * {q} + 1)"
    q = f"({p} - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    return f"""CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 WHEN {p} < {ACKLAM_LOW} THEN {tail_of(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - ACKLAM_LOW} THEN -({tail_of(f'sqrt(-2 * ln(1 - {p}))')})
        ELSE {horner(r, ACKLAM_A)} * {q} / ({horner(r, ACKLAM_B)} * {r} + 1) END"""


EFFECT = f"""SELECT mode, strategy, round(CASE WHEN count(*) >= 2 AND max(d) > min(d) THEN avg(d) / stddev_samp(d) ELSE 0 END, 6) AS cohens_d, round(CASE WHEN count(*) >= 2 AND max(d) > min(d) THEN stddev_samp(d) ELSE 0 END, 6) AS diff_sd,
    round(CASE WHEN count(*) >= 2 AND max(d) > min(d) THEN (({normal_quantile('0.975::DOUBLE')}) + ({normal_quantile('0.8::DOUBLE')})) * stddev_samp(d) / sqrt(count(*)) ELSE 0 END, 6) AS mde FROM di GROUP BY ALL"""
WILCOXON = f""", z AS (SELECT mode, strategy, d, round(abs(d), 12) AS a FROM di WHERE d <> 0),
    rk AS (SELECT *, rank() OVER (PARTITION BY mode, strategy ORDER BY a) + (count(*) OVER (PARTITION BY mode, strategy, a) - 1) / 2::DOUBLE AS r, count(*) OVER (PARTITION BY mode, strategy, a)::DOUBLE AS c FROM z),
    w AS (SELECT mode, strategy, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum((c * c - 1) / 48) AS tie FROM rk GROUP BY ALL),
    v AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - tie AS var, greatest(abs(w - n * (n + 1) / 4) - 0.5::DOUBLE, 0) AS gap FROM w),
    p AS (SELECT mode, strategy, CASE WHEN n < 2 OR var <= 0 THEN 1 ELSE least(1, 2 * (1 - {normal_cdf('(gap / sqrt(var))')})) END AS w_p FROM v)
    SELECT mode, strategy, round(coalesce(w_p, 1), 6) AS w_p FROM (SELECT DISTINCT mode, strategy FROM di) LEFT JOIN p USING (mode, strategy)"""

_THETA = "atan(abs(t) / sqrt(n - 1))"
_COS2 = f"pow(cos({_THETA}), 2)"
_ODD = f"2 / pi() * ({_THETA} + CASE WHEN n - 1 > 1 THEN sin({_THETA}) * cos({_THETA}) * (1 + coalesce(list_sum(list_transform(range(1, (n - 4) // 2 + 1), lambda k: exp(k * ln({_COS2}) + lgamma(k + 1) - lgamma(k + 1.5::DOUBLE) + lgamma(1.5::DOUBLE)))), 0)) ELSE 0 END)"
_EVEN = f"sin({_THETA}) * (1 + coalesce(list_sum(list_transform(range(1, (n - 3) // 2 + 1), lambda k: exp(k * ln({_COS2}) + lgamma(k + {HALF}) - lgamma(k + 1) - lgamma({HALF})))), 0))"
#: Student's t and its p from the finite series, with the products written as gamma functions.
T_TEST = f"""ts AS (SELECT mode, strategy, count(*) AS n, CASE WHEN count(*) < 2 OR (max(d) = min(d) AND avg(d) = 0) THEN 0 WHEN max(d) = min(d) THEN 'infinity'::DOUBLE * sign(avg(d)) ELSE avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM di GROUP BY ALL),
    tp AS (SELECT mode, strategy, t, CASE WHEN n < 2 THEN 1 WHEN isinf(t) THEN 0 ELSE greatest(0, least(1, 1 - CASE WHEN (n - 1) % 2 = 1 THEN {_ODD} ELSE {_EVEN} END)) END AS t_p FROM ts)"""
HOLM = """hs AS (SELECT *, least(1, (count(*) OVER (PARTITION BY mode) - row_number() OVER (PARTITION BY mode ORDER BY t_p, strategy) + 1) * t_p) AS q FROM tp),
    ho AS (SELECT *, max(q) OVER (PARTITION BY mode ORDER BY t_p, strategy ROWS UNBOUNDED PRECEDING) AS p_holm FROM hs)"""

#: Places drawn n of n by the hash of iteration and draw, and the interval of the resampled means.
BOOTSTRAP = f"""bn AS (SELECT mode, strategy, d, row_number() OVER (PARTITION BY mode, strategy ORDER BY query_id, d) - 1 AS place, count(*) OVER (PARTITION BY mode, strategy) AS n FROM di WHERE d IS NOT NULL),
    i0 AS (SELECT i, (i * {MIX[2]} + {SEED}) & 2147483647 AS a FROM range({ITERATIONS}) r(i)), i1 AS (SELECT i, ((xor(a, a >> 16) * {MIX[0]}) & 2147483647) AS a FROM i0), i2 AS (SELECT i, ((xor(a, a >> 15) * {MIX[1]}) & 2147483647) AS a FROM i1), i3 AS (SELECT i, xor(a, a >> 16) AS a FROM i2),
    w0 AS (SELECT n, i, (a + j * {MIX[1]}) & 2147483647 AS x FROM i3, (SELECT DISTINCT n FROM bn), range((SELECT max(n) FROM bn)) r(j) WHERE j < n), w1 AS (SELECT n, i, ((xor(x, x >> 16) * {MIX[0]}) & 2147483647) AS x FROM w0), w2 AS (SELECT n, i, ((xor(x, x >> 15) * {MIX[1]}) & 2147483647) AS x FROM w1),
    w3 AS (SELECT n, i, (xor(x, x >> 16) * n) >> 31 AS place, count(*) AS c FROM w2 GROUP BY ALL),
    bm AS (SELECT mode, strategy, i, sum(d * c) / max(bn.n) AS m FROM bn JOIN w3 USING (n, place) GROUP BY ALL),
    bc AS (SELECT mode, strategy, round(quantile_cont(m, 0.025::DOUBLE), 6) AS ci_low, round(quantile_cont(m, 0.975::DOUBLE), 6) AS ci_high FROM bm GROUP BY ALL)"""

PAIRS = """r AS (SELECT doc_id, rater, max(reading_level) AS level FROM reading_labels WHERE reading_level BETWEEN 1 AND 5 GROUP BY ALL),
    pr AS (SELECT doc_id, least(3, arg_min(level, rater) - 1) AS g1, least(3, arg_max(level, rater) - 1) AS g2 FROM r WHERE rater IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)"""
KAPPA = """, c AS (SELECT g1, g2, count(*) AS c FROM pr GROUP BY ALL), a AS (SELECT g1, sum(c) AS x FROM c GROUP BY ALL), b AS (SELECT g2, sum(c) AS y FROM c GROUP BY ALL),
    e AS (SELECT sum(x * y * pow(g1 - g2, 2) / 9) / (SELECT sum(c) FROM c) AS chance FROM a, b), s AS (SELECT sum(c * pow(g1 - g2, 2) / 9) AS seen FROM c)
    SELECT round(CASE WHEN chance > 0 THEN 1 - seen / chance ELSE 0 END, 6) AS kappa FROM e, s"""

_CATALOG = f"""bk AS (SELECT book_id, b.* FROM (SELECT book_id, arg_max(struct_pack(authors := authors, y := original_publication_year, lang := language_code, genre := genre), struct_pack(r := received_at, c := ratings_count)) AS b FROM books WHERE book_id IS NOT NULL GROUP BY book_id)),
    cat AS (SELECT book_id, TRY_CAST(trunc(TRY_CAST(trim(y) AS DOUBLE)) AS INT) AS publication_year, {LANGUAGE} AS language, coalesce(genre, '') AS genre, len(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS n_authors FROM bk)"""
_TAGS = values([(t, g, i) for i, (t, g) in enumerate(GENRE_TAGS)], "tg", "tag, genre, place") + ", tm AS (SELECT lower(tag) AS tag_lower, arg_min(genre, place) AS genre FROM tg GROUP BY ALL), tc AS (SELECT book_id, genre AS tag, coalesce(ratings_count, 0) AS c FROM books WHERE genre IS NOT NULL AND book_id IS NOT NULL)"
_TOTALS = f"{_TAGS}, gt AS (SELECT book_id, tm.genre, sum(c)::BIGINT AS n FROM tc JOIN tm ON lower(tc.tag) = tm.tag_lower GROUP BY ALL)"

_VECTORS = f"vs AS (SELECT vec_id AS doc_id, {hashed('vec_id')} AS stripe, embedding::DOUBLE[] AS e, label FROM embeddings)"


def nearest(home: str = "vs", k: int = 50) -> str:
    return f"""vh AS (SELECT * FROM (SELECT q.doc_id AS query_id, c.stripe, c.doc_id, round(list_cosine_similarity(q.e, c.e), 9) AS score, row_number() OVER (PARTITION BY q.doc_id, c.stripe ORDER BY round(list_cosine_similarity(q.e, c.e), 9) DESC, c.doc_id) AS hit_rank
        FROM vs q, {home} c WHERE q.doc_id % 50 = 0) WHERE hit_rank <= {k})"""


_SCALE = "coalesce(list_max(list_transform(e, lambda x: abs(x))), 0) / 127::DOUBLE"
_QUANT = "list_transform(e, lambda x: CASE WHEN s > 0 THEN greatest(-127, least(127, round_even(x / s, 0))) ELSE 0 END)"


#: A rescored hit; queries without terms keep the raw score.
_AGAIN = "CASE WHEN EXISTS (SELECT 1 FROM qt WHERE qt.query_id = c.query_id) THEN coalesce(b, 0) ELSE score END"
_SCORES = "sc AS (SELECT query_id, stripe, min(score) AS lo, max(score) AS hi, avg(score) AS m, stddev_pop(score) AS sd FROM cand GROUP BY ALL), " + answering("cand", "query_id")
_QUOTAS = "rs AS (SELECT query_id, stripe, n_docs AS n FROM (SELECT DISTINCT query_id, stripe FROM cand) JOIN dn USING (stripe)), qu AS (SELECT *, greatest(1, round_even(10 * n / sum(n) OVER (PARTITION BY query_id)::DOUBLE, 0)) AS quota FROM rs)"
_ANY = [
    ("naive-score", "score", ""),
    ("interleave", INTERLEAVED, "JOIN st USING (query_id, stripe_pos)"),
    ("global-rrf", "1 / (60::DOUBLE + hit_rank)", ""),
    ("quota-merge", "-hit_rank::DOUBLE", "JOIN qu USING (query_id, stripe) WHERE hit_rank <= quota"),
    ("minmax-norm", "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END", "JOIN sc USING (query_id, stripe)"),
    ("zscore-norm", "CASE WHEN hi > lo THEN (score - m) / sd ELSE 0 END", "JOIN sc USING (query_id, stripe)"),
]
_LEGGED = [("vector-similarity", "coalesce(vector_similarity, CASE WHEN mode = 'Vector' THEN score END)", "")]
_WORDED = [
    ("idf-correct-probe", CORRECTED, "LEFT JOIN fac USING (query_id, stripe)"),
    ("idf-correct-sidecar", CORRECTED, "LEFT JOIN fac USING (query_id, stripe)"),
    ("global-bm25", _AGAIN, "LEFT JOIN gb USING (query_id, doc_id)"),
    ("local-bm25", _AGAIN, "LEFT JOIN lb USING (query_id, doc_id)"),
]


def _arm(mode: str, ctes: str, plans: list[tuple], worded: bool, queries: str) -> str:
    """Rows (kind, query_id, doc_id, rank) of one mode: lists, the un-split list, and the queries of each strategy."""
    summed = "SELECT query_id, mode, doc_id, arg_min(stripe, struct_pack(p := stripe_pos, r := hit_rank)) AS stripe, min(stripe_pos) AS stripe_pos, min(hit_rank) AS hit_rank, sum(1 / (60::DOUBLE + hit_rank)) AS fused FROM cand GROUP BY query_id, mode, doc_id"
    bodies = {n: "WITH " + tail(f"SELECT c.*, {e} AS fused FROM cand c {j}", digits=12 if n == "naive-score" else 9) for n, e, j in plans}
    bodies["rrf-sum"] = "WITH " + tail(summed)
    if mode == "Hybrid":
        bodies["hybrid-legs"] = f"WITH hits AS (SELECT * FROM cand), {tail(_LEGS)}"
    if worded:
        for name, threshold in (("selective-one", 1.0), ("selective-adaptive", 0.35)):
            several = tail(f"SELECT c.*, {_AGAIN} AS fused FROM kept c LEFT JOIN gb USING (query_id, doc_id) WHERE chosen > 1")
            bodies[name] = f"WITH {chosen(threshold)}, {several} UNION ALL SELECT query_id, mode, doc_id, stripe, fused_score, fused_rank FROM one WHERE fused_rank <= 10"
        bodies["single-index-rescored"] = "WITH " + tail(f"SELECT c.*, {_AGAIN} AS fused FROM orc c LEFT JOIN gb USING (query_id, doc_id)")
    names = "nm AS (SELECT unnest([" + ", ".join(f"'{mode}|{n}|'" for n in bodies) + "]) AS nm)"
    made = " UNION ALL ".join(f"SELECT 'l', '{mode}|{n}|' || query_id, doc_id, fused_rank FROM ({b})" for n, b in bodies.items())
    return f"""SELECT * FROM (WITH {ctes}, {_SCORES}, {_QUOTAS}{f', {FACTORS}, {GLOBAL}, {LOCAL}' if worded else ''}, {names},
        tr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(reranker_score, score) DESC, hit_rank) AS rank FROM orc)
        SELECT 't' AS kind, nm || query_id AS query_id, doc_id, rank FROM tr, nm UNION ALL SELECT 'q', nm || query_id, NULL, NULL FROM ({queries}), nm UNION ALL {made})"""


def _arms() -> str:
    """The rows of every mode."""
    asked = "SELECT vec_id::VARCHAR AS query_id FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL"
    placed = "CASE stripe WHEN 'a' THEN 0 ELSE 1 END AS stripe_pos"
    keyword = retrieval(asked=EVALUATED) + ", dn AS (SELECT stripe, n_docs FROM sz)"
    whole = lambda home: nearest(f"(SELECT * REPLACE ('all' AS stripe) FROM {home})").replace("vh AS", "vo AS")
    vector = f"""{_VECTORS}, {nearest()}, {whole('vs')}, dn AS (SELECT stripe, count(*) AS n_docs FROM vs GROUP BY ALL),
        wide AS (SELECT * REPLACE (query_id::VARCHAR AS query_id), 'Vector' AS mode, {placed}, score AS vector_similarity FROM vh), cand AS (SELECT * FROM wide WHERE hit_rank <= 25),
        orc AS (SELECT query_id::VARCHAR AS query_id, doc_id, score, hit_rank, NULL::DOUBLE AS reranker_score FROM vo)"""
    titles = "q AS (SELECT doc_id::VARCHAR AS query_id, title AS text FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL))"
    text = retrieval(asked=titles)
    for n in ("cand", "wide", "orc"):
        text = text.replace(f" {n} AS (", f" k_{n} AS (")
    both = "coalesce(1 / (60::DOUBLE + t.hit_rank), 0) + coalesce(1 / (60::DOUBLE + v.hit_rank), 0)"
    hybrid = f"""{text}, {_VECTORS}, hv AS (SELECT vs.* REPLACE (tok.stripe AS stripe) FROM vs JOIN tok USING (doc_id)), {nearest('hv')}, {whole('hv')}, dn AS (SELECT stripe, n_docs FROM sz),
        v1 AS (SELECT * REPLACE (query_id::VARCHAR AS query_id) FROM vh), v2 AS (SELECT * REPLACE (query_id::VARCHAR AS query_id) FROM vo), k1 AS (SELECT * FROM kw WHERE hit_rank <= 50),
        h1 AS (SELECT query_id, stripe, doc_id, t.score AS text_score, v.score AS vector_similarity, round({both}, 9) AS score FROM k1 t FULL JOIN v1 v USING (query_id, stripe, doc_id)),
        wide AS (SELECT * FROM (SELECT *, 'Hybrid' AS mode, {placed}, row_number() OVER (PARTITION BY query_id, stripe ORDER BY score DESC, doc_id) AS hit_rank FROM h1) WHERE hit_rank <= 50), cand AS (SELECT * FROM wide WHERE hit_rank <= 25),
        h2 AS (SELECT query_id, doc_id, t.score AS text_score, v.score AS vector_similarity, round({both}, 9) AS score FROM k_orc t FULL JOIN v2 v USING (query_id, doc_id)),
        orc AS (SELECT o.*, 'all' AS stripe, 'Hybrid' AS mode, 0 AS stripe_pos, CASE WHEN n > 0 THEN round(4 * coalesce(h, 0) / n::DOUBLE, 9) END AS reranker_score
                FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank FROM h2) WHERE hit_rank <= 50) o LEFT JOIN held USING (query_id, doc_id) LEFT JOIN nt USING (query_id))"""
    arms = [_arm("Keyword", keyword, _ANY + _WORDED, True, "SELECT query_id FROM q"), _arm("Vector", vector, _ANY + _LEGGED, False, asked), _arm("Hybrid", hybrid, _ANY + _LEGGED + _WORDED, True, asked)]
    return " UNION ALL ".join(arms)


def pooled() -> str:
    """Every document that any list of any mode holds."""
    return f"WITH every AS MATERIALIZED ({_arms()}) SELECT DISTINCT split_part(query_id, '|', 3) AS query_id, doc_id FROM every WHERE kind IN ('l', 't')"


def evaluated() -> str:
    """Queries x modes x strategies, every metric."""
    covered = f"{_COVERAGE} SELECT query_id, round(coalesce(v, 0), 6) AS judged_coverage FROM qs LEFT JOIN c USING (query_id)"
    parts = " ".join(f"JOIN (WITH dummy AS (SELECT 1) {m}) m{i} USING (query_id)" for i, m in enumerate((_NDCG, _OVERLAP, _KENDALL, _RBO, _JUDGED, covered)))
    return f"""WITH {HITS}, every AS MATERIALIZED ({_arms()}), li AS (SELECT query_id, doc_id, rank FROM every WHERE kind = 'l'), tr AS (SELECT query_id, doc_id, rank FROM every WHERE kind = 't'), qs AS (SELECT query_id FROM every WHERE kind = 'q'),
        sh AS (SELECT li.query_id, li.doc_id, li.rank AS rc, tr.rank AS ro FROM li JOIN tr USING (query_id, doc_id)),
        j0 AS (SELECT query_id, doc_id, least(3, greatest(0, floor(max(vector_similarity) * 4)))::INT AS grade FROM hits WHERE mode = 'Hybrid' AND vector_similarity <= 1 GROUP BY ALL),
        ju AS (SELECT qs.query_id, doc_id, grade FROM j0 JOIN qs ON split_part(qs.query_id, '|', 3) = j0.query_id)
        SELECT split_part(query_id, '|', 3) AS query_id, split_part(query_id, '|', 1) AS mode, split_part(query_id, '|', 2) AS strategy, ndcg, recall, jaccard, kendall_tau, rbo, judged_ndcg, judged_coverage FROM qs {parts}"""


def named_spans() -> str:
    """The span of each query by the rule of ``functions.labels``: number by enumeration, or the one nearest name."""
    word, number = "lower(regexp_replace(span, '[^\\p{L}\\p{Nd}]', '', 'g'))", "regexp_extract(lower(regexp_replace(span, '[^\\p{L}\\p{Nd}.-]', '', 'g')), '^\\.*0*(\\d+)(?:\\.0*)?\\.?$', 1)"
    near = lambda n, o: f"(levenshtein(w, '{n.lower()}') <= 2 AND levenshtein(w, '{n.lower()}') < levenshtein(w, '{o.lower()}'))"
    a, b = CATEGORIES["span"]
    named = f"CASE WHEN length(w) = 0 THEN NULL WHEN i = '1' OR {near(b, a)} THEN '{b}' WHEN i = '0' OR {near(a, b)} THEN '{a}' END"
    return f"sp AS (SELECT query_id, arg_max(s, struct_pack(r := received_at, s := s)) AS span FROM (SELECT query_id, received_at, {named} AS s FROM (SELECT query_id, received_at, {word} AS w, {number} AS i FROM eval_queries)) WHERE s IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    plain = lambda c: f"regexp_replace({c}, '[^A-Za-z]', '', 'g')"
    t = token_ctes()
    out["route_category"] = f"WITH {CORPUS} SELECT doc_id, stripe FROM corpus"
    out["route_temporal"] = f"WITH {_CATALOG} SELECT book_id, CASE WHEN publication_year IS NULL THEN {hashed('book_id')} WHEN publication_year <= 1980 THEN 'a' ELSE 'b' END AS stripe FROM cat"
    out["route_hash"] = f"SELECT doc_id, {hashed('doc_id')} AS stripe FROM documents"
    out["oracle_fanout"] = f"WITH {CORPUS} SELECT 'stripes' AS arm, stripe AS index_name, stripe, count(*) AS n FROM corpus GROUP BY ALL UNION ALL SELECT 'oracle', 'all', stripe, count(*) FROM corpus GROUP BY ALL"
    seven = hashed("doc_id").replace(":42", ":7")
    out["split_catalog"] = f"""WITH {CORPUS}, s AS (SELECT 'category' AS split, stripe AS part FROM corpus UNION ALL SELECT 'random-42', {hashed('doc_id')} FROM corpus UNION ALL SELECT 'random-7', {seven} FROM corpus
        UNION ALL SELECT 'temporal-500', CASE WHEN doc_id <= 500 THEN 'a' ELSE 'b' END FROM corpus) SELECT split, part, count(*) AS n_docs FROM s GROUP BY ALL"""
    out["tokenize"] = f"SELECT doc_id, len({toks('text')}) AS n_tokens, array_to_string({toks('text')}, ' ') AS tokens FROM documents"
    first = "list_filter(x, lambda v, i: list_position(x, v) = i)"
    out["query_terms"] = f"SELECT DISTINCT query_id, array_to_string({first}, ' ') AS terms FROM (SELECT query_id, {toks('text')} AS x FROM eval_queries WHERE query_id IS NOT NULL)"
    out["idf"] = f"WITH {t} SELECT term, df, round({idf('df', 'n_docs')}, 6) AS idf FROM dfg, gsz"
    out["normalize_language"] = f"SELECT doc_id, {LANGUAGE} AS language FROM documents"
    out["parse_numeric"] = "SELECT book_id, TRY_CAST(trunc(TRY_CAST(trim(original_publication_year) AS DOUBLE)) AS INT) AS year, coalesce(average_rating, 0) AS rating, count(*) AS n FROM books GROUP BY ALL"
    out["split_authors"] = "SELECT DISTINCT book_id, array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors FROM books"
    out["catalog_rows"] = f"WITH {_CATALOG} SELECT * FROM cat"
    out["parse_grade"] = r"SELECT doc_id, CASE WHEN regexp_extract(text, '\p{Nd}', 0) IN ('0', '1', '2', '3') THEN regexp_extract(text, '\p{Nd}', 0)::INT END AS grade FROM documents"
    out["split_custom_id"] = "SELECT DISTINCT query_id, doc_id::VARCHAR AS doc FROM candidates"
    out["embedding_input"] = "SELECT doc_id, sha256(coalesce(title, '') || ' by ' || coalesce(source, '') || '. ' || coalesce(text, '')) AS digest FROM documents"
    out["json_fields"] = "SELECT event_type, props::JSON ->> '$.page' AS page, props::JSON ->> '$.device' AS device, count(*) AS n FROM events GROUP BY ALL"
    out["vector_quantize"] = f"WITH {_VECTORS}, sc AS (SELECT *, {_SCALE} AS s FROM vs) SELECT doc_id, round(s, 6) AS scale, array_to_string(list_transform({_QUANT}, lambda x: x::INT::VARCHAR), ',') AS q FROM sc"
    out["vector_dequantize"] = f"WITH {_VECTORS}, sc AS (SELECT *, {_SCALE} AS s FROM vs), b AS (SELECT doc_id, e, list_transform({_QUANT}, lambda x: x * s) AS r FROM sc) SELECT doc_id, round(list_max(list_transform(list_zip(r, e), lambda z: abs(z[1] - z[2]))), 6) AS largest_error, round(list_cosine_similarity(r, e), 6) AS cosine FROM b"
    # corpus statistics
    out["df_local"] = f"WITH {t} SELECT stripe, term, df FROM dfl"
    out["df_global"] = f"WITH {t} SELECT term, df FROM dfg"
    out["df_rollup"] = f"WITH {t} SELECT term, stripe AS scope, df FROM dfl UNION ALL SELECT term, 'all', df FROM dfg"
    out["stripe_stats"] = f"WITH {t} SELECT stripe, n_docs, round(avgdl, 6) AS avgdl FROM sz"
    side = f"""sd AS (SELECT term, sum(df)::BIGINT AS df, coalesce(sum(CASE WHEN stripe = 'a' THEN df END), 0)::BIGINT AS df_a, coalesce(sum(CASE WHEN stripe = 'b' THEN df END), 0)::BIGINT AS df_b FROM dfl GROUP BY ALL),
        sw AS (SELECT *, {idf('df_a', "(SELECT n_docs FROM sz WHERE stripe = 'a')")} AS idf_a, {idf('df_b', "(SELECT n_docs FROM sz WHERE stripe = 'b')")} AS idf_b FROM sd), sg AS (SELECT *, round(abs(idf_a - idf_b), 9) AS gap FROM sw)"""
    out["idf_divergence"] = f"WITH {t}, {side} SELECT term, df, df_a, df_b, round(idf_a, 6) AS idf_a, round(idf_b, 6) AS idf_b, round(gap, 6) AS gap FROM sg WHERE df >= 40 ORDER BY sg.gap DESC, term LIMIT 10"
    out["size_imbalance"] = f"WITH {t} SELECT round(max(n_docs) / min(n_docs), 6) AS size_ratio, round(ln(max(n_docs) / min(n_docs)), 6) AS predicted_gap, round((max(avgdl) - min(avgdl)) / min(avgdl) * 100, 6) AS length_gap_percent FROM sz"
    bands = " ".join(f"WHEN df >= {a} {f'AND df < {b}' if b else ''} THEN '{a}{f'-{b - 1}' if b else '+'}'" for a, b in zip(BANDS, (*BANDS[1:], None)))
    out["idf_band_decay"] = f"WITH {t}, {side} SELECT band, count(*) AS terms, round(avg(gap), 6) AS mean_gap FROM (SELECT *, CASE {bands} END AS band FROM sg) WHERE band IS NOT NULL GROUP BY ALL"
    # retrieval
    r = retrieval()
    hit = "query_id, stripe, doc_id, hit_rank, round(score, 9) AS score"
    out["keyword_topk"] = f"WITH {r} SELECT {hit} FROM wide"
    out["oracle_topk"] = f"WITH {r} SELECT {hit} FROM orc"
    out["filtered_retrieval"] = f"""WITH {r}, f AS (SELECT kws.* FROM kws JOIN corpus USING (doc_id) WHERE language = 'en')
        SELECT {hit} FROM (SELECT query_id, stripe, doc_id, score, row_number() OVER (PARTITION BY query_id, stripe ORDER BY score DESC, doc_id) AS hit_rank FROM f) WHERE hit_rank <= 10"""
    out["vector_topk"] = f"WITH {_VECTORS}, {nearest()} SELECT {hit} FROM vh"
    out["semantic_scores"] = f"WITH {r} SELECT {hit}, round(reranker_score, 9) AS reranker_score FROM cand"
    out["fan_out"] = f"WITH {r} SELECT query_id, stripe, count(*) AS returned FROM cand GROUP BY ALL"
    out["candidate_budget"] = f"WITH {r} SELECT query_id, count(*) AS returned, 'equalized' AS budget FROM cand GROUP BY ALL UNION ALL SELECT query_id, count(*), 'per-index' FROM wide GROUP BY ALL"
    out["df_probe"] = f"WITH {r} SELECT stripe, term, df FROM dfl WHERE term IN (SELECT term FROM qt)"
    out["doc_counts"] = f"WITH {CORPUS} SELECT stripe, count(*) AS n_docs FROM corpus GROUP BY ALL"
    names = f"""q AS (SELECT doc_id AS query_id, title AS text FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), qt AS (SELECT query_id, unnest(list_distinct({toks('text')})) AS term FROM q),
        post AS (SELECT doc_id, stripe, doc_len, term, count(*) AS tf FROM (SELECT doc_id, stripe, doc_len, unnest(tokens) AS term FROM tokl) GROUP BY ALL),
        ks AS (SELECT query_id, stripe, doc_id, round(sum({bm25('df', 'n_docs', 'tf', 'doc_len', 'avgdl')}), 9) AS score FROM post JOIN qt USING (term) JOIN dfl USING (stripe, term) JOIN sz USING (stripe) GROUP BY ALL),
        th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stripe ORDER BY score DESC, doc_id) AS hit_rank FROM ks) WHERE hit_rank <= 50),
        hm AS (SELECT vs.doc_id, corpus.stripe, e FROM vs JOIN corpus USING (doc_id)), {nearest('hm')},
        hy AS (SELECT query_id, stripe, doc_id, th.score AS text_score, vh.score AS vector_similarity, round(coalesce(1 / (60::DOUBLE + th.hit_rank), 0) + coalesce(1 / (60::DOUBLE + vh.hit_rank), 0), 9) AS score FROM th FULL JOIN vh USING (query_id, stripe, doc_id))"""
    out["hybrid_topk"] = f"WITH {t}, {_VECTORS}, {names} SELECT {hit}, round(text_score, 9) AS text_score, round(vector_similarity, 9) AS vector_similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stripe ORDER BY score DESC, doc_id) AS hit_rank FROM hy) WHERE hit_rank <= 50"
    # fusion of the delivered hits
    out["naive_score"] = f"WITH {HITS}, {tail('SELECT *, score AS fused FROM hits', digits=12)}"
    out["interleave"] = over_hits(INTERLEAVED, joins="JOIN st USING (query_id, mode, stripe_pos)", more=answering("hits", "query_id, mode"))
    out["global_rrf"] = over_hits("1 / (60::DOUBLE + hit_rank)")
    out["rrf_sum"] = f"WITH {HITS}, {tail('SELECT query_id, mode, doc_id, arg_min(stripe, struct_pack(p := stripe_pos, r := hit_rank)) AS stripe, min(stripe_pos) AS stripe_pos, min(hit_rank) AS hit_rank, sum(1 / (60::DOUBLE + hit_rank)) AS fused FROM hits GROUP BY query_id, mode, doc_id')}"
    spread = "sp AS (SELECT query_id, mode, stripe, min(score) AS lo, max(score) AS hi, avg(score) AS m, stddev_pop(score) AS sd FROM hits GROUP BY ALL)"
    out["minmax_norm"] = over_hits("CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END", joins="JOIN sp USING (query_id, mode, stripe)", more=spread)
    out["zscore_norm"] = over_hits("CASE WHEN hi > lo THEN (score - m) / sd ELSE 0 END", joins="JOIN sp USING (query_id, mode, stripe)", more=spread)
    out["vector_similarity"] = over_hits("coalesce(vector_similarity, CASE WHEN mode = 'Vector' THEN score END)")
    out["semantic_score"] = over_hits("reranker_score")
    out["hybrid_legs"] = LEGS
    shares = "dn AS (SELECT stripe, count(*) AS n FROM documents WHERE stripe IS NOT NULL GROUP BY ALL), rs AS (SELECT query_id, mode, stripe, coalesce(n, 0) AS n FROM (SELECT DISTINCT query_id, mode, stripe FROM hits) LEFT JOIN dn USING (stripe)), qu AS (SELECT *, greatest(1, round_even(10 * n / sum(n) OVER (PARTITION BY query_id, mode)::DOUBLE, 0)) AS quota FROM rs)"
    out["quota_merge"] = over_hits("-hit_rank::DOUBLE", where="hit_rank <= quota", joins="JOIN qu USING (query_id, mode, stripe)", more=shares)
    out["select_pool"] = f"""WITH {HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode, doc_id ORDER BY hit_rank, stripe_pos) AS o FROM hits),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY hit_rank, stripe_pos, doc_id) AS pool_rank FROM o WHERE o = 1) SELECT query_id, mode, doc_id, stripe, pool_rank FROM p WHERE pool_rank <= 50"""
    shown = lambda x, n: f"round({x}::DECIMAL(30, 12), {n})::DECIMAL(30, {n})::VARCHAR"
    sc, lo, hi, mean, sd = (shown(x, 4) for x in ("score", "lo", "hi", "m", "sd"))
    fs = lambda n=4: shown("round(fused, 9)", n)
    told = [
        ("naive-score", "SELECT *, score AS fused FROM hits", 12, f"'@search.score=' || {sc} || ' from ' || stripe"),
        ("interleave", f"SELECT h.*, {INTERLEAVED} AS fused FROM hits h JOIN st USING (query_id, mode, stripe_pos)", 9, "'rank ' || hit_rank || ' in ' || stripe"),
        ("global-rrf", "SELECT *, 1 / (60::DOUBLE + hit_rank) AS fused FROM hits", 9, f"'1/(60+' || hit_rank || ') = ' || {fs(6)} || ' from ' || stripe"),
        ("minmax-norm", "SELECT h.*, lo, hi, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS fused FROM hits h JOIN sp USING (query_id, mode, stripe)", 9, f"'(' || {sc} || '-' || {lo} || ')/(' || {hi} || '-' || {lo} || ') = ' || {fs()} || ' in ' || stripe"),
        ("zscore-norm", "SELECT h.*, m, sd, CASE WHEN hi > lo THEN (score - m) / sd ELSE 0 END AS fused FROM hits h JOIN sp USING (query_id, mode, stripe)", 9, f"'z=(' || {sc} || '-' || {mean} || ')/' || {sd} || ' = ' || {fs()} || ' in ' || stripe"),
        ("vector-similarity", "SELECT *, coalesce(vector_similarity, CASE WHEN mode = 'Vector' THEN score END) AS fused FROM hits", 9, f"'cosine=' || {fs()} || ' from ' || stripe"),
        ("semantic-score", "SELECT *, reranker_score AS fused FROM hits", 9, f"'reranker=' || {fs(3)} || ' (0-4), from ' || stripe"),
        ("quota-merge", "SELECT h.*, quota, pc, -hit_rank::DOUBLE AS fused FROM hits h JOIN (SELECT *, round(100 * n / sum(n) OVER (PARTITION BY query_id, mode)::DOUBLE)::INT AS pc FROM qu) USING (query_id, mode, stripe) WHERE hit_rank <= quota", 9, "'quota ' || quota::INT || ' (' || pc || '% of corpus), rank ' || hit_rank || ' in ' || stripe"),
        ("hybrid-legs", _LEGS, 9, f"concat_ws(' + ', 'text#' || round(1 / t - 60)::INT, 'vector#' || round(1 / v - 60)::INT) || ' = ' || {fs(6)} || ' from ' || stripe"),
    ]
    out["explain_fusion"] = f"WITH {HITS}, {answering('hits', 'query_id, mode')}, {spread}, {shares} {explained(told)}"
    # fusion of retrieved candidates
    out["idf_factors"] = f"WITH {r}, {FACTORS} SELECT query_id, stripe, round(factor, 6) AS factor FROM fac"
    corrected = over("cand", CORRECTED, "LEFT JOIN fac USING (query_id, stripe)", FACTORS)
    out["idf_correct_sidecar"] = out["idf_correct_probe"] = corrected
    out["merge_idf"] = over("wide", CORRECTED, "LEFT JOIN fac USING (query_id, stripe)", FACTORS)
    out["global_bm25"] = over("cand", RESCORED, "LEFT JOIN gb USING (query_id, doc_id)", GLOBAL)
    out["local_bm25"] = over("cand", RESCORED, "LEFT JOIN lb USING (query_id, doc_id)", LOCAL)
    out["merge_naive"] = f"WITH {r}, {tail('SELECT *, score AS fused FROM cand', digits=12)}"
    out["merge_bm25"] = over("cand", RESCORED, "LEFT JOIN gb USING (query_id, doc_id)", GLOBAL, stop=False)
    out["merge_vector"] = f"WITH {_VECTORS}, {nearest(k=25)}, {tail('''SELECT query_id, 'Vector' AS mode, doc_id, stripe, CASE stripe WHEN 'a' THEN 0 ELSE 1 END AS stripe_pos, hit_rank, score AS fused FROM vh''')}"
    out["selective_one"], out["selective_adaptive"] = selective(1.0), selective(0.35)
    out["semantic_merge"] = over("cand", "reranker_score")
    out["rerank_existing"] = over("wide", "reranker_score + 0.01::DOUBLE * ln(1::DOUBLE + doc_len)", "JOIN tokl d ON d.doc_id = c.doc_id")
    out["semantic_rerank"] = over("cand", "reranker_score + 0.01::DOUBLE * ln(1::DOUBLE + doc_len)", "JOIN tokl d ON d.doc_id = c.doc_id")
    pool = """po AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hit_rank, stripe_pos) AS po FROM cand), pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, stripe_pos, doc_id) AS pool_rank FROM po WHERE po = 1) WHERE pool_rank <= 50)"""
    out["external_rerank"] = over("pl", "greatest(0, floor(reranker_score * 0.75::DOUBLE)) + greatest(0, least(1000, score)) / 100000::DOUBLE", more=pool)
    out["agentic_rerank"] = over("wide", "reranker_score", k=50)
    out["agentic_cheap"] = over("wide", INTERLEAVED, "JOIN st USING (query_id, stripe_pos)", answering("wide", "query_id"), k=50)
    halved = f"""SELECT query_id AS whole_id, query_id || '.' || i AS sub_id, CASE WHEN len(t) < 2 THEN text WHEN i = 1 THEN array_to_string(t[1:(len(t) + 1) // 2], ' ') ELSE array_to_string(t[(len(t) + 1) // 2 + 1:], ' ') END AS text
        FROM (SELECT query_id, text, coalesce(list_filter(x, lambda v, i: list_position(x, v) = i), []) AS t FROM (SELECT query_id, text, {toks('text')} AS x FROM q)), (VALUES (1), (2)) v(i) WHERE i = 1 OR len(t) >= 2"""
    whole = "sw AS (SELECT rw.whole_id AS query_id, w.* EXCLUDE (query_id) FROM wide w JOIN rw ON w.query_id = rw.sub_id)"
    planned = lambda asked: f"{asked.replace(' q AS', ' qa AS') if ' q AS' in asked else asked.replace('q AS', 'qa AS', 1)}, rw AS MATERIALIZED ({halved.replace('FROM q)', 'FROM qa)')}), q AS (SELECT sub_id AS query_id, text FROM rw)"
    out["agentic_planned"] = over("sw", "reranker_score", more=whole, k=50, asked=planned(STATED))
    out["single_index"] = f"WITH {r} SELECT query_id, mode, doc_id, stripe, round(coalesce(reranker_score, score), 9) AS fused_score, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(reranker_score, score) DESC, hit_rank) AS fused_rank FROM orc) WHERE fused_rank <= 10"
    out["single_index_rescored"] = over("orc", RESCORED, "LEFT JOIN gb USING (query_id, doc_id)", GLOBAL)
    given = "CASE WHEN EXISTS (SELECT 1 FROM fac f2 WHERE f2.query_id = c.query_id) THEN coalesce(text_score, score) ELSE score END"
    was = shown("coalesce(text_score, score)", 4)
    counted = "ht AS (SELECT query_id, doc_id, count(*) AS h FROM tf GROUP BY ALL)"
    bm = lambda b: f"SELECT c.*, ht.h AS hh, nt.n AS nn, {RESCORED} AS fused FROM cand c LEFT JOIN {b} USING (query_id, doc_id) LEFT JOIN ht USING (query_id, doc_id) LEFT JOIN nt USING (query_id)"
    said = lambda kind: f"'{kind} BM25 ' || {fs()} || ' over ' || coalesce(hh, 0) || '/' || nn || ' query terms (was ' || {was} || ' in ' || stripe || ')'"
    told = [
        ("idf-correct-probe", f"SELECT c.*, factor, {given} AS gv, {CORRECTED} AS fused FROM cand c LEFT JOIN fac USING (query_id, stripe)", 9, f"{shown('gv', 4)} || ' x ' || {shown('coalesce(factor, 1)', 3)} || ' = ' || {fs()} || ' (' || stripe || ' IDF correction)'"),
        ("global-bm25", bm("gb"), 9, said("global")),
        ("local-bm25", bm("lb"), 9, said("local")),
        ("external-rerank", "SELECT *, CASE WHEN doc_id % 3 > 0 THEN floor(reranker_score * 0.75::DOUBLE)::INT END AS gr, coalesce(CASE WHEN doc_id % 3 > 0 THEN greatest(0, floor(reranker_score * 0.75::DOUBLE)) END, 0) + greatest(0, least(1000, score)) / 100000::DOUBLE AS fused FROM pl", 9, "CASE WHEN gr >= 0 THEN 'external grade ' || gr || '/3 (from ' || stripe || ')' ELSE 'ungraded (from ' || stripe || ')' END"),
    ]
    out["explain_search"] = f"WITH {r}, {FACTORS}, {GLOBAL}, {LOCAL}, {counted}, {pool} {explained(told)}"
    plans = [
        ("naive-score", "score", ""),
        ("global-rrf", "1 / (60::DOUBLE + hit_rank)", ""),
        ("minmax-norm", "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END", "JOIN sc USING (query_id, stripe)"),
        ("zscore-norm", "CASE WHEN hi > lo THEN (score - m) / sd ELSE 0 END", "JOIN sc USING (query_id, stripe)"),
        ("global-bm25", RESCORED, "LEFT JOIN gb USING (query_id, doc_id)"),
        ("idf-correct-probe", CORRECTED, "LEFT JOIN fac USING (query_id, stripe)"),
    ]
    every = " UNION ALL ".join(f"SELECT '{n}' AS strategy, query_id, doc_id FROM (WITH {tail(f'SELECT c.*, {e} AS fused FROM cand c {j}')})" for n, e, j in plans)
    out["evaluate_matrix"] = f"""WITH {r}, {FACTORS}, {GLOBAL}, sc AS (SELECT query_id, stripe, min(score) AS lo, max(score) AS hi, avg(score) AS m, stddev_pop(score) AS sd FROM cand GROUP BY ALL), li AS ({every}),
        tr AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(reranker_score, score) DESC, hit_rank) AS x FROM orc) WHERE x <= 10),
        g AS (SELECT DISTINCT q.query_id, li.strategy FROM q, (SELECT DISTINCT strategy FROM li) li),
        k AS (SELECT query_id, strategy, (SELECT count(*) FROM li WHERE li.query_id = g.query_id AND li.strategy = g.strategy) AS na, (SELECT count(*) FROM tr WHERE tr.query_id = g.query_id) AS nb,
              (SELECT count(*) FROM li JOIN tr USING (query_id, doc_id) WHERE li.query_id = g.query_id AND li.strategy = g.strategy) AS nab FROM g)
        SELECT query_id, strategy, round(CASE WHEN nb > 0 THEN nab / nb::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN na + nb = 0 THEN 1 ELSE nab / (na + nb - nab)::DOUBLE END, 6) AS jaccard FROM k"""
    # metrics
    out["ndcg"], out["judged_ndcg"], out["overlap_at_k"], out["kendall_tau"], out["rbo"], out["identical_topk"] = (lists(x) for x in (_NDCG, _JUDGED, _OVERLAP, _KENDALL, _RBO, _SAME))
    out["judged_coverage"] = lists(_COVERAGE + " SELECT query_id, round(coalesce(v, 0), 6) AS judged_coverage FROM qs LEFT JOIN c USING (query_id)")
    out["stripe_contribution"] = lists("SELECT query_id, string_agg(stripe || '=' || n, ' | ' ORDER BY stripe) AS stripe_mix FROM (SELECT query_id, stripe, count(*) AS n FROM li GROUP BY ALL) GROUP BY ALL")
    out["judgment_pool"] = lists("SELECT query_id, doc_id FROM li UNION SELECT query_id, doc_id FROM tr")
    out["apply_judgments"] = lists(_COVERAGE + f", {RECORDS} SELECT record_id, round(CASE WHEN qs.query_id IS NOT NULL THEN coalesce(v, 0) END, 6) AS judged_coverage FROM rec LEFT JOIN qs ON qs.query_id = rec.query_id LEFT JOIN c ON c.query_id = rec.query_id")
    # evaluation records
    six = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
    out["strategy_summary"] = f"WITH {SUMMARY} SELECT mode, strategy, queries, {six('ndcg', 'judged_ndcg', 'compute_units', 'agentic_tokens', 'latency_p50_ms', 'latency_p95_ms')} FROM su"
    span = f"sp AS (SELECT query_id, min(s) AS span FROM (SELECT query_id, CASE lower({plain('span')}) WHEN 'stripelocal' THEN 'StripeLocal' WHEN 'crossstripe' THEN 'CrossStripe' END AS s FROM eval_queries) WHERE s IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL)"
    out["span_breakdown"] = f"WITH {RECORDS}, {span}, x AS (SELECT mode, strategy, coalesce(avg(CASE WHEN span = 'StripeLocal' THEN ndcg END), 0) AS l, coalesce(avg(CASE WHEN span = 'CrossStripe' THEN ndcg END), 0) AS c FROM rec JOIN sp USING (query_id) GROUP BY ALL) SELECT mode, strategy, round(l, 6) AS local_ndcg, round(c, 6) AS cross_ndcg, round(c - l, 6) AS delta FROM x"
    out["span_breakdown_named"] = out["span_breakdown"].replace(span, named_spans())
    out["paired_differences"] = f"WITH {differences()} {PAIRED}"
    out["bootstrap_ci"] = f"WITH {differences()}, {BOOTSTRAP} SELECT * FROM bc"
    out["effect_size"] = f"WITH {differences()} {EFFECT}"
    out["wilcoxon"] = f"WITH {differences()} {WILCOXON}"
    out["paired_t"] = f"WITH {differences()}, {T_TEST} SELECT mode, strategy, round(t, 6) AS t, round(t_p, 6) AS t_p FROM tp"
    out["holm"] = f"WITH {differences()}, {T_TEST}, {HOLM} SELECT mode, strategy, round(p_holm, 6) AS p_holm FROM ho"
    out["significance_table"] = f"""WITH {differences()}, {T_TEST}, {HOLM}, {BOOTSTRAP}, pd AS ({PAIRED}), ef AS ({EFFECT}), wi AS (SELECT * FROM (WITH dummy AS (SELECT 1) {WILCOXON}))
        SELECT mode, strategy, n, mean, ci_low, ci_high, wins, losses, ties, round(t, 6) AS t, round(t_p, 6) AS t_p, w_p, cohens_d, round(p_holm, 6) AS p_holm FROM pd JOIN bc USING (mode, strategy) JOIN ef USING (mode, strategy) JOIN wi USING (mode, strategy) JOIN ho USING (mode, strategy)"""
    dec = lambda x, n: f"round(round({x}, 6)::DECIMAL(30, 12), {n})::DECIMAL(30, {n})::VARCHAR"
    out["formatted_significance"] = f"""WITH {differences()}, {T_TEST}, pd AS ({PAIRED}), tk AS (SELECT mode, strategy, avg(agentic_tokens) AS tokens FROM rec GROUP BY ALL)
        SELECT mode, strategy, CASE WHEN {dec('mean', 3)}::DOUBLE < 0 OR (mean < 0) THEN '' ELSE '+' END || {dec('mean', 3)} AS mean, CASE WHEN round(t_p, 6) < 0.0001 THEN '<0.0001' ELSE {dec('t_p', 4)} END AS p, coalesce({dec('tokens', 1)}, '—') AS tokens
        FROM pd JOIN tp USING (mode, strategy) JOIN tk USING (mode, strategy)"""
    arms = differences("ndcg", "naive-score", "strategy IN ('naive-score', 'global-rrf')")
    out["compare"] = f"WITH {arms}, {T_TEST}, pd AS ({PAIRED}) SELECT pd.*, round(t, 6) AS t, round(t_p, 6) AS t_p FROM pd JOIN tp USING (mode, strategy)"
    out["compute_model"] = f"WITH {HITS} SELECT query_id, mode, round(0.00017::DOUBLE * count(DISTINCT stripe) + 0.0000054::DOUBLE * count(*), 9) AS compute_units FROM hits GROUP BY ALL"
    semantic = ", ".join(f"'{x.name}'" for x in STRATEGIES if x.needs_semantic)
    out["cost_tradeoff"] = f"""WITH {SUMMARY}, b AS (SELECT mode, coalesce(judged_ndcg, 0) AS q, compute_units AS c FROM su WHERE strategy = 'single-index'),
        k AS (SELECT strategy, avg(len(string_split(stripe_mix, ' | '))) AS calls FROM rec WHERE strategy IN ({semantic}) AND stripe_mix IS NOT NULL GROUP BY ALL),
        j AS (SELECT su.*, b.q, b.c, round_even(coalesce(calls, 0), 0) + round_even(coalesce(agentic_tokens, 0), 0) * 0.000022::DOUBLE AS m FROM su JOIN b USING (mode) LEFT JOIN k USING (strategy))
        SELECT mode, strategy, round(coalesce(judged_ndcg, 0), 8) AS quality, round(CASE WHEN q > 0 THEN coalesce(judged_ndcg, 0) / q END, 8) AS vs_single, round(m, 8) AS metered_per_1k, round(m + coalesce(compute_units, 0) * 270::DOUBLE, 8) AS serverless_per_1k,
        round(CASE WHEN compute_units > 0 AND c > 0 THEN compute_units / c END, 8) AS capacity, round(CASE WHEN compute_units > 0 AND c > 0 THEN c / compute_units END, 8) AS peak_qps, round(latency_p50_ms, 8) AS latency_p50_ms FROM j"""
    named = ", ".join(f"('{x.name}', {str(x.own_retrieval).upper()})" for x in STRATEGIES)
    out["query_accounting"] = f"""WITH f AS (SELECT query_id, stripe, count(DISTINCT mode) AS r, count(*) AS n, 0.00017::DOUBLE + 0.0000054::DOUBLE * count(*) AS u FROM candidates GROUP BY ALL),
        a AS (SELECT query_id, sum(r)::BIGINT AS r, sum(u) AS c, max(n)::DOUBLE AS l, count(*) AS r1, sum(u / r) AS c1, max(n / r) AS l1 FROM f GROUP BY ALL), nm(strategy, own) AS (VALUES {named})
        SELECT query_id, strategy, CASE WHEN own THEN r1 ELSE r END AS queries, round(CASE WHEN own THEN c1 ELSE c END, 6) AS compute_units, round(CASE WHEN own THEN l1 ELSE l END, 6) AS latency_ms FROM a, nm"""
    out["probe_cache"] = f"WITH {r} SELECT n AS query_no, 2 * count(*) AS probes FROM (SELECT term, min(regexp_extract(query_id, '\\d+')::BIGINT) AS n FROM qt GROUP BY ALL) GROUP BY ALL"
    out["explain_query"] = f"""WITH {r}, li AS (SELECT * FROM ({'WITH ' + tail('SELECT *, 1 / (60::DOUBLE + hit_rank) AS fused FROM cand')})), mx AS (SELECT query_id, string_agg(stripe || '=' || n, ' | ' ORDER BY stripe) AS m FROM (SELECT query_id, stripe, count(*) AS n FROM li GROUP BY ALL) GROUP BY ALL)
        SELECT query_id, 'stripe' AS part, stripe, hit_rank AS place, doc_id, round(score, 9) AS score, round(text_score, 9) AS text_score, round(reranker_score, 9) AS reranker_score, NULL AS explanation FROM cand WHERE hit_rank <= 10
        UNION ALL SELECT query_id, 'fused', li.stripe, fused_rank, doc_id, fused_score, NULL, NULL, printf('1/(60+%d) = %.6f from %s', cand.hit_rank, fused_score, li.stripe) FROM li JOIN cand USING (query_id, doc_id) WHERE li.stripe = cand.stripe
        UNION ALL SELECT query_id, 'mix', NULL, NULL, NULL, NULL, NULL, NULL, m FROM mx"""
    out["verify_counts"] = "SELECT stripe AS source, count(*) AS n_docs FROM documents GROUP BY ALL"
    checks = [("vectors", "(SELECT count(*) FROM embeddings) > 0"), ("one vector size", "(SELECT count(DISTINCT len(embedding)) FROM embeddings) = 1"), ("stripes", "(SELECT count(DISTINCT stripe) FROM documents) >= 2"), ("no empty stripe", "(SELECT count(stripe) FROM documents) > 0")]
    checks += [(f"{c} present", f"(SELECT count({c}) FROM candidates) > 0") for c in ("text_score", "vector_similarity", "reranker_score")]
    checks += [("second stage within 0 to 4", "coalesce((SELECT min(reranker_score) >= 0 AND max(reranker_score) <= 4 AND NOT bool_or(isnan(reranker_score)) FROM candidates), FALSE)"), ("statistics of every stripe", "(SELECT min(terms) > 0 AND min(avgdl) > 0 FROM sz LEFT JOIN (SELECT stripe, count(*) AS terms FROM dfl GROUP BY ALL) USING (stripe))")]
    out["doctor"] = f"WITH {t} " + " UNION ALL ".join(f"SELECT '{a}' AS check, {b} AS ok" for a, b in checks)
    out["result_rows"] = f"WITH {RECORDS} SELECT DISTINCT query_id AS queryId, mode, strategy, judged_ndcg AS judgedNdcg, agentic_tokens AS agenticTokens, stripe_mix AS stripeMix FROM rec"
    out["embed_pending"] = "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS characters, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS blanks, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS es FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"
    out["query_embeddings"] = "WITH k AS (SELECT title, min(label)::DOUBLE AS label FROM embeddings JOIN documents ON doc_id = vec_id WHERE title IS NOT NULL GROUP BY ALL) SELECT doc_id AS query_id, label FROM documents LEFT JOIN k USING (title)"
    out |= files.oracle_sql(toks("text"), RECORDS)
    # judges
    out["weighted_kappa"] = f"WITH {PAIRS} {KAPPA}"
    out["judge_agreement"] = f"WITH {PAIRS} SELECT count(*) AS n, round(avg((g1 = g2)::INT), 6) AS exact, round(avg((abs(g1 - g2) <= 1)::INT), 6) AS within_one, round(avg(g1), 6) AS mean_1, round(avg(g2), 6) AS mean_2, round(avg(g2) - avg(g1), 6) AS shift, round(coalesce(CASE WHEN isnan(corr(g1, g2)) THEN 0 ELSE corr(g1, g2) END, 0), 6) AS pearson FROM pr"
    out["confusion_matrix"] = f"WITH {PAIRS} SELECT g1, " + ", ".join(f"sum((g2 = {i})::INT)::BIGINT AS g2_{i}" for i in range(4)) + " FROM pr GROUP BY ALL"
    out["grade_histogram"] = "WITH g AS (SELECT greatest(0, least(3, reading_level)) AS grade, count(*) AS n FROM reading_labels WHERE reading_level IS NOT NULL GROUP BY ALL) SELECT grade, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(sum(CASE WHEN grade >= 2 THEN n ELSE 0 END) OVER () / sum(n) OVER ()::DOUBLE, 6) AS relevant_share FROM g"
    out["normal_functions"] = f"SELECT round(p, 6) AS p, round({normal_quantile('p')}, 6) AS z, round({normal_cdf('p')}, 6) AS cdf FROM (SELECT DISTINCT vector_similarity AS p FROM candidates WHERE vector_similarity > 0 AND vector_similarity < 1)"
    # preparing a corpus
    out["tag_genre_map"] = f"WITH {_TAGS} SELECT tag, tm.genre, count(*) AS n FROM tc JOIN tm ON lower(tc.tag) = tm.tag_lower GROUP BY ALL"
    out["genre_totals"] = f"WITH {_TOTALS} SELECT * FROM gt"
    out["primary_genre"] = f"WITH {_TOTALS} SELECT b.book_id, coalesce(first(genre ORDER BY n DESC, genre), '') AS primary_genre, coalesce(string_agg(genre, ',' ORDER BY n DESC, genre), '') AS genres FROM (SELECT DISTINCT book_id FROM books WHERE book_id IS NOT NULL) b LEFT JOIN gt ON gt.book_id = b.book_id GROUP BY b.book_id"
    out["category_counts"] = f"WITH {_CATALOG} SELECT genre AS category, count(*) AS n FROM cat GROUP BY ALL"
    out["blurb_join"] = "SELECT book_id, count(*) AS n FROM (SELECT DISTINCT book_id FROM books) JOIN documents USING (book_id) WHERE regexp_matches(text, '[^\\s\\p{Z}]') GROUP BY ALL"
    out["pending_rows"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL)"
    out["upsert"] = "SELECT record_id, CASE WHEN NOT isnan(l) THEN l END AS latency_ms FROM (SELECT record_id, (arg_max(struct_pack(l := latency_ms), ingested_at)).l AS l FROM eval_records WHERE record_id IS NOT NULL GROUP BY ALL)"
    place = "p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)"
    out["stride_sample"] = f"WITH {place} SELECT doc_id FROM p WHERE place IN (SELECT (i * n) // least(300, n) FROM (SELECT max(n) AS n FROM p), range(300) r(i) WHERE i < n)"
    out["stride_sample_int"] = f"WITH {place} SELECT doc_id FROM p WHERE place % greatest(1, n // 300) = 0 AND place < greatest(1, n // 300) * 300"
    out["latency_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS largest FROM events GROUP BY ALL"
    # the searches again over every evaluation query
    out |= {f"eval_{n}": x.replace(STATED, EVALUATED) for n, x in out.items() if STATED in x}
    out["eval_agentic_planned"] = over("sw", "reranker_score", more=whole, k=50, asked=planned(EVALUATED))
    out["evaluate_all"] = evaluated()
    out["judgment_pool_all"] = pooled()
    out["hybrid_legs_by_range"] = out["hybrid_legs"]
    return out
