"""Approximate nearest neighbours through learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection. A softmax classifier learns which part
a vector belongs to. Every vector of the table is indexed under its most probable part; a query is routed to as many of its
most probable parts as the sample needed to find ``TARGET_RECALL`` of its neighbours, and the exact cosine ranks what is found there.

Equal vectors are one class, of which the ``k + 1`` smallest ids can matter to any query, so a vector that many rows share costs no more
than another. A part larger than ``BLOCK`` classes is searched in several tasks, and so are many queries of one part.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates; vectors are compared
with those of their own length, and lengths other than the commonest are searched completely; ties go to the smaller id; a query
with fewer than ``k`` candidates gets all of them; rows without an id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import join_groups
from cellpulse.plans.storage import durable

SAMPLE = 4_096
PART_ROWS = 400
MAX_PARTS = 64
NEIGHBOURS = 12
TARGET_RECALL = 0.97
BLOCK = 8_192
QUERY_BLOCK = 4_096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k nearest others by cosine."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1_024):
        near = x[at : at + 1_024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1_024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _split(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves that cut few edges: the second eigenvector of the walk on the graph, split at its median."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(len(nodes))
    ends = place[graph[nodes]]
    source, target = np.nonzero(ends >= 0)[0], ends[ends >= 0]
    n = len(nodes)
    degree = np.bincount(source, minlength=n) + np.bincount(target, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(80):
        x = x - (x * degree).sum() / degree.sum()
        y = x + np.bincount(source, x[target], n) + np.bincount(target, x[source], n)
        x = 0.5 * x + 0.5 * y / degree
        x /= max(np.abs(x).max(), 1e-300)
    order = np.argsort(x, kind="stable")
    return nodes[order[: n // 2]], nodes[order[n // 2 :]]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The part of each node; ``parts`` is a power of two and sizes differ by at most one at each cut."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _split(g, graph, rng)]
    out = np.empty(len(graph), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on unit vectors by accelerated gradient descent."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    pw, pb, hot = w, b, np.eye(parts)[part]
    rate = 8.0 * min(parts, x.shape[1]) ** 0.5
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
        z = x @ vw + vb
        e = np.exp(z - z.max(1, keepdims=True))
        gap = (e / e.sum(1, keepdims=True) - hot) / len(x)
        w, b = vw - rate * (x.T @ gap + 1e-5 * vw), vb - rate * gap.sum(0)
    return w, b


@dataclass
class Router:
    """``probes`` parts are searched for each query."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-(unit(x) @ self.weights + self.bias), axis=1, kind="stable")[:, :many]


def fit(sample: np.ndarray, parts: int, k: int) -> Router:
    x = unit(sample.astype(float))
    parts = min(parts, 1 << max(0, (len(x) // (2 * NEIGHBOURS)).bit_length() - 1)) or 1
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    weights, bias = fit_router(x, balanced_parts(graph, parts), parts)
    order = Router(weights, bias, parts).ranked(x, parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    needed = np.sort(rank[np.arange(len(x))[:, None], order[graph[:, : max(1, k)], 0]].ravel())
    enough = int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))]) + 1
    return Router(weights, bias, min(parts, enough))


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _routed(rows: DataFrame, router: Router, dim: int, many: int) -> DataFrame:
    """Add ``cell``, one row for each of the ``many`` most probable parts; other lengths have a cell of their own."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        own = vectors.map(len) == dim
        out = vectors.map(lambda v: [-len(v)])
        if own.any():
            found = router.ranked(np.vstack(vectors[own].to_list()).astype(float), many)
            out[own] = pd.Series(list(found.astype(np.int32)), index=out.index[own])
        return out

    return rows.withColumn("cell", F.explode(cells("vec")))


def _rank(k: int):  # noqa: ANN202
    def rank(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        rows = rows.sort_values("cls")
        c, ids = np.vstack(rows["vec"].to_list()).astype(float), rows["cls"].to_numpy()
        norms = np.sqrt((c * c).sum(1))
        out = []
        many = min(len(c), 2 * k + 6)
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q = np.vstack(part["vec"].to_list()).astype(float)
            near = (q @ c.T) / norms
            level = -np.partition(-near, many - 1, axis=1)[:, many - 1]
            for j, name in enumerate(part["cls"].to_numpy()):
                # all that reach the level, ties included, are scored one by one, so that rounding cannot depend on the block
                places = np.flatnonzero(near[j] >= level[j] - 1e-9 * abs(level[j]) - 1e-300)
                exact = (c[places] * q[j]).sum(1) / (norms[places] * np.sqrt((q[j] * q[j]).sum()))
                best = np.lexsort((ids[places], -exact))[: k + 1]
                out.append(pd.DataFrame({"query": name, "cls": ids[places][best], "score": exact[best]}))
        return pd.concat(out)

    return rank


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where ``is_query`` holds, against all other rows."""
    wide = dict(vectors.dtypes)[vec_col] != "array<float>"
    vec = F.col(vec_col).cast("array<double>" if wide else "array<float>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec"), is_query.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("vec")))
    # the smallest ids of each class; the filter on the row number already cuts every class down before the shuffle
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    ids = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"))
    classes = durable(ids.join(sizes, "vec").select(F.get("ids", F.lit(0)).alias("cls"), "vec", "ids", "n", "asked"), "classes")
    lengths = classes.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, total = (lengths[0]["dim"], lengths[0]["count"]) if lengths else (1, 0)
    sample = classes.filter(F.size("vec") == dim).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vec").toPandas()
    parts = 1 << max(0, min(MAX_PARTS, total // PART_ROWS).bit_length() - 1)
    router = fit(np.vstack(sample["vec"].to_list()), parts, k) if total else Router(np.zeros((1, 1)), np.zeros(1), 1)

    indexed = durable(_routed(classes.select("cls", "vec"), router, dim, 1), "index")
    asked = durable(_routed(classes.filter("asked").select("cls", "vec"), router, dim, router.probes), "routed")
    blocks = lambda size, name: (F.ceil(F.count(F.lit(1)) / size)).cast("int").alias(name)
    plan = indexed.groupBy("cell").agg(blocks(BLOCK, "_rb")).join(asked.groupBy("cell").agg(blocks(QUERY_BLOCK, "_qb")), "cell")
    plan = F.broadcast(plan)  # one row per part, and per odd length
    mine = lambda count: F.pmod(F.xxhash64("cls"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    q = asked.join(plan, "cell").select("cls", "vec", "cell", mine("_qb").alias("qb"), every("_rb").alias("rb"))
    r = indexed.join(plan, "cell").select("cls", "vec", "cell", every("_qb").alias("qb"), mine("_rb").alias("rb"))
    keys = ["cell", "qb", "rb"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_rank(k), "query long, cls long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    nearest = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    members = nearest.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = members.withColumn("_n", F.row_number().over(row)).filter(F.col("_n") <= k + 1)
    answers = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("answer"))
    known = classes.filter("asked").select("cls", "vec", "n").join(answers.withColumnRenamed("query", "cls"), "cls").select("vec", "n", "answer")

    queries = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "vec")
    named = join_groups(queries, known, "vec", "n", total)
    own = F.filter("answer", lambda a: a["vec_id"] != F.col("query_id"))
    out = named.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("_at", "_hit"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), "_hit.vec_id", "_hit.score")
