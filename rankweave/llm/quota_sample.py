"""Samples that match target category proportions (problem 5)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import labels
from ..functions.labels import CATEGORIES
from .common import durable, settled
from .topn import top_n

CELL = list(CATEGORIES)
#: Places of an enumeration that fit into the number that orders deliveries.
PLACES = 8


def _spelled(rows: DataFrame) -> DataFrame:
    """Of each label ``_c`` its letters and digits (``_c_word``) and the number it is (``_c_number``)."""
    made = {}
    for c in CELL:
        made |= {f"_{c}_word": labels.word(F.col(f"_{c}")), f"_{c}_number": labels.number(F.col(f"_{c}"))}
    return settled(settled(rows, **made), **{f"_{c}_edits": labels.edits(F.col(f"_{c}_word"), v) for c, v in CATEGORIES.items()})


def _place(c: str, names: list[str]) -> Column:
    return labels.place(F.col(f"_{c}_word"), F.col(f"_{c}_number"), F.col(f"_{c}_edits"), names)


def labelled(queries: DataFrame, set_col: str = "set_id", id_col: str = "query_id", arrived: str = "received_at") -> DataFrame:
    """One row per query whose labels can all be recognised: (set, id, labels).

    Of several deliveries each label is taken from the last that has a recognisable one; of equally late ones the
    category further on in its enumeration counts. Rows without set or id are left out. Time and category are one
    number, so that the deliveries are merged by hash and not sorted.
    """
    raw = queries.filter(F.col(set_col).isNotNull() & F.col(id_col).isNotNull()).select(set_col, id_col, arrived, *[F.col(c).alias(f"_{c}") for c in CELL])
    time = F.unix_micros(arrived) if raw.schema[arrived].dataType.typeName() == "timestamp" else F.col(arrived).cast("long")
    since = F.coalesce(time, F.lit(-(1 << 55))) * F.lit(PLACES)
    known = _spelled(raw).select(set_col, id_col, *[(since + _place(c, v)).alias(c) for c, v in CATEGORIES.items()])
    last = known.groupBy(set_col, id_col).agg(*[F.max(c).alias(c) for c in CELL]).dropna(subset=CELL)
    return last.select(set_col, id_col, *[labels.name_at(F.pmod(c, F.lit(PLACES)).cast("int"), v).alias(c) for c, v in CATEGORIES.items()])


def max_flow(n: int, edges: list[tuple[int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each edge of a maximum flow (shortest augmenting paths); n nodes, edges (from, to, capacity)."""
    to, left, out = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(to))
        to.append(b)
        left.append(c)
        out[b].append(len(to))
        to.append(a)
        left.append(0)
    while True:
        came = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for e in out[a]:
                if left[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if sink not in came:
            return [left[2 * i + 1] for i in range(len(edges))]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = to[came[at] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def controlled_rounding(table: np.ndarray) -> np.ndarray:
    """An integer table whose cells, row sums, column sums and total are each the fractional one rounded down or up.

    The fractional parts are a feasible flow from rows to columns with lower bounds, so a whole one exists; it is
    found as a maximum flow in the network in which the lower bounds are moved to an extra source and sink.
    """
    t = np.round(np.asarray(table, dtype=float), 6)
    base = np.floor(t).astype(int)
    rows, cols = t.shape
    down, up = lambda x: int(np.floor(round(x, 6))), lambda x: int(np.ceil(round(x, 6)))
    s, z, extra_s, extra_z = rows + cols, rows + cols + 1, rows + cols + 2, rows + cols + 3
    bounded = [(s, i, down(t[i].sum()) - base[i].sum(), up(t[i].sum()) - base[i].sum()) for i in range(rows)]
    bounded += [(i, rows + j, 0, int(t[i, j] > base[i, j])) for i in range(rows) for j in range(cols)]
    bounded += [(rows + j, z, down(t[:, j].sum()) - base[:, j].sum(), up(t[:, j].sum()) - base[:, j].sum()) for j in range(cols)]
    want = int(np.floor(round(t.sum(), 6) + 0.5)) - base.sum()
    bounded.append((z, s, want, want))
    edges = [(a, b, int(hi - lo)) for a, b, lo, hi in bounded]
    for a, b, lo, _ in bounded:
        if lo:
            edges += [(extra_s, b, int(lo)), (a, extra_z, int(lo))]
    flow = max_flow(rows + cols + 4, edges, extra_s, extra_z)
    cell = np.array([flow[k] for k in range(rows, rows + rows * cols)]).reshape(rows, cols)
    return base + cell


@F.pandas_udf(ArrayType(LongType()))
def quotas(cells: pd.Series) -> pd.Series:
    """The quotas of each set's cells (row, column, need), by controlled rounding of its table."""
    out = []
    for group in cells:
        rows, cols = ({x: i for i, x in enumerate(dict.fromkeys(c[name] for c in group))} for name in ("row", "col"))
        table = np.zeros((len(rows), len(cols)))
        at = [(rows[c["row"]], cols[c["col"]]) for c in group]
        for (i, j), c in zip(at, group):
            table[i, j] = c["need"]
        whole = controlled_rounding(table)
        out.append([int(whole[i, j]) for i, j in at])
    return pd.Series(out)


def quota_plan(queries: DataFrame, targets: DataFrame, set_col: str = "set_id") -> DataFrame:
    """A row per target cell: (set, shape, span, intent, need, available, quota, take, short).

    ``need`` is the larger of share x sample size and the minimum; ``quota`` makes the needs of a set whole by
    controlled rounding over shape x (span, intent), keeping both margins; ``take`` is what the set gives of the
    quota; ``short`` says that the cell gives all it has and that this is less than it needs. A cell stated several
    times counts once, with its largest need. Null shares and minima count as 0; cells with a null set or category
    are left out. A set has at most 18 cells, so its plan is made in one array; the queries are only counted.
    """
    have = labelled(queries, set_col).groupBy(set_col, *CELL).agg(F.count(F.lit(1)).alias("available"))
    share = F.coalesce(F.when(~F.isnan("target_share"), F.col("target_share")), F.lit(0.0)) * F.coalesce(F.col("sample_size"), F.lit(0))
    need = F.greatest(F.round(share, 6), F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), F.lit(0.0))
    stated = _spelled(targets.select(set_col, need.alias("need"), *[F.col(c).alias(f"_{c}") for c in CELL]))
    wanted = stated.select(set_col, *[labels.name_at(_place(c, v), v).alias(c) for c, v in CATEGORIES.items()], "need").dropna(subset=[set_col, *CELL]).groupBy(set_col, *CELL).agg(F.max("need").alias("need"))
    plan = wanted.join(have, [set_col, *CELL], "left").select(set_col, *CELL, "need", F.coalesce("available", F.lit(0)).alias("available"))
    cell = F.struct(*CELL, "need", "available", F.col("shape").alias("row"), F.concat_ws("|", "span", "intent").alias("col"))
    sets = plan.groupBy(set_col).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    table = F.transform("_cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["need"].alias("need")))
    whole = settled(sets, _quotas=quotas(table)).select(set_col, F.inline(F.arrays_zip(F.col("_cells").alias("c"), F.col("_quotas").alias("quota"))).alias("c", "quota"))
    given = whole.select(set_col, *[F.col(f"c.{x}").alias(x) for x in [*CELL, "need", "available"]], "quota").withColumn("take", F.least("quota", "available"))
    return given.withColumn("short", (F.col("take") == F.col("available")) & (F.col("take") < F.col("need")))


def draw(queries: DataFrame, plan: DataFrame, seed: int = 42, set_col: str = "set_id", id_col: str = "query_id") -> DataFrame:
    """The sample itself: of each cell the ``take`` queries with the smallest random key (a hash of seed and id).

    The draw is exact, repeatable and the same however the data are partitioned; cells are cut by the salted
    two-stage ranking, so a cell with a third of all queries is no bottleneck. The plan's few rows are written once
    to the shared folder, as the ranking reads them several times.
    """
    cell = F.concat_ws("␟", F.col(set_col).cast("string"), *CELL)
    known = labelled(queries, set_col, id_col).select(cell.alias("cell"), F.col(id_col), (-F.xxhash64(F.lit(seed), F.col(id_col)).cast("double")).alias("key"))
    limits = durable(plan.filter("take > 0").select(cell.alias("cell"), "take", set_col, *CELL))
    chosen = top_n(known, limits.select("cell", "take"), "cell", id_col, "key", "take")
    return chosen.join(limits.drop("take"), "cell").select(set_col, *CELL, id_col)
