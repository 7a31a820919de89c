"""Nearest neighbours by inner product: a vantage-point tree per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.cut import cut

LEAF = 64
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
TREE = "shard int, n int, dims int, ids binary, vectors binary, nodes binary"
HITS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """`vec_id, v` (doubles) of the vectors that are not null or zero and hold no null or non-finite number."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever its row stands, so that equal vectors tie."""
    return np.einsum("ij,kj->ki", x, q, optimize=False)


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and nodes (first, last, inside child, outside child, vantage row, radius) of a tree.

    A node takes the row farthest from its mean as vantage point and splits the others at the median distance; the
    inside ones are at most, the outside ones at least `radius` away. Leaves have up to LEAF rows, or more where
    all distances are the same.
    """
    order, nodes = np.arange(len(vectors)), []

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, -1, -1, 0.0])
        if b - a <= LEAF:
            return me
        rows = vectors[order[a:b]]
        point = int(np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))
        far = np.sqrt(((rows - rows[point]) ** 2).sum(axis=1))
        far[point] = -1
        by = np.argsort(far, kind="stable")
        half = (b - a) // 2
        radius = far[by[half]]
        half = int(np.searchsorted(far[by], radius, "left"))
        if half <= 1:
            half = int(np.searchsorted(far[by], radius, "right"))
            if half >= b - a:
                return me
            radius = far[by[half]]
        order[a:b] = order[a:b][by]
        inside, outside = grow(a + 1, a + half), grow(a + half, b)
        nodes[me] = [a, b, inside, outside, a, radius]
        return me

    if len(vectors):
        grow(0, len(vectors))
    return order, np.array(nodes, float).reshape(-1, 6)


class _Best:
    """The k best rows so far of each query: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score >= self.score[queries, -1][:, None]).any(axis=1)
        queries, score = queries[good], score[good]
        if not len(queries):
            return
        s = np.concatenate([self.score[queries], score], axis=1)
        i = np.concatenate([self.id[queries], np.broadcast_to(ids, score.shape)], axis=1)
        keep = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[queries], self.id[queries] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)


def search_tree(ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> _Best:
    """The k rows of largest inner product with each query, its own id excepted.

    Largest inner product is smallest distance once rows get one more number that gives all the same length, and
    queries a zero there. Every query first goes down to one leaf; then each node is visited by all queries that the
    triangle inequality, with the k-th distance divided by `factor`, does not send past it.
    """
    best = _Best(len(q), k)
    long = np.sqrt((x * x).sum(axis=1))
    top = long.max(initial=0.0)
    extra = np.sqrt(np.maximum(0, top**2 - long**2))
    length = (q * q).sum(axis=1)

    def look(queries: np.ndarray, a: int, b: int) -> None:
        for first in range(0, len(queries), 1024):
            part = queries[first : first + 1024]
            s = scores(x[a:b], q[part])
            s[query_ids[part][:, None] == ids[None, a:b]] = -np.inf
            best.add(part, s, ids[a:b])

    def reach(queries: np.ndarray) -> np.ndarray:
        # A little is added so that rounding never sends a query past a row that ties.
        return np.sqrt(np.maximum(0, length[queries] + top**2 - 2 * best.score[queries, -1])) / factor + 1e-6 * (top + 1)

    def away(queries: np.ndarray, row: int) -> np.ndarray:
        inner = np.einsum("j,kj->k", x[row], q[queries], optimize=False)
        return np.sqrt(np.maximum(0, length[queries] + long[row] ** 2 + extra[row] ** 2 - 2 * inner))

    leaf_of = np.full(len(q), -1)
    stack = [(0, np.arange(len(q)))] if len(nodes) else []
    while stack:
        at, queries = stack.pop()
        a, b, inside, outside, point, radius = nodes[at]
        if inside < 0:
            leaf_of[queries] = at
            look(queries, int(a), int(b))
            continue
        near = away(queries, int(point)) < radius
        stack += [(int(child), part) for child, part in ((outside, queries[~near]), (inside, queries[near])) if len(part)]
    stack = [(0, np.arange(len(q)))] if len(nodes) else []
    while stack:
        at, queries = stack.pop()
        a, b, inside, outside, point, radius = nodes[at]
        if inside < 0:
            look(queries[leaf_of[queries] != at], int(a), int(b))
            continue
        look(queries, int(point), int(point) + 1)
        far, within = away(queries, int(point)), reach(queries)
        for child, part in ((outside, queries[far + within >= radius]), (inside, queries[far - within <= radius])):
            if len(part):
                stack.append((int(child), part))
    return best


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A table with one tree per row, over shards of about `shard_rows` of the `usable` vectors; all are indexed."""
    shards = vectors.count() // shard_rows + 1

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        out = []
        for dims, part in rows.groupby(rows["v"].map(len)):
            x = np.stack(part["v"].to_list()).astype("<f8")
            long = (x * x).sum(axis=1)
            order, nodes = build_tree(np.column_stack([x, np.sqrt(np.maximum(0, long.max() - long))]))
            ids = part["vec_id"].to_numpy("<i8")[order]
            out.append((int(part["shard"].iat[0]), len(ids), dims, ids.tobytes(), x[order].tobytes(), nodes.astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["shard", "n", "dims", "ids", "vectors", "nodes"])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(tree, TREE)


def search(index: DataFrame, queries: DataFrame, k: int, factor: float, query_rows: int = QUERY_ROWS) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest rows of `index` for each row (`vec_id, v`) of `queries`.

    Queries are dealt into blocks of about `query_rows`; a block meets one tree at a time in a task, and the k hits
    of each tree are merged by one more ranking. A query never finds its own id.
    """
    index = cut(index)
    shards = index.select("shard").distinct()
    blocks = queries.count() // query_rows + 1
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    last = shards.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0]
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))) if last >= 0 else F.lit(0))
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = asked["v"].map(len) if len(asked) else None
        for t in trees.itertuples():
            part = asked[sizes == t.dims] if len(asked) else asked
            if not len(part):
                continue
            x, ids = np.frombuffer(t.vectors, "<f8").reshape(t.n, t.dims), np.frombuffer(t.ids, "<i8")
            query_ids = part["vec_id"].to_numpy(np.int64)
            best = search_tree(ids, x, np.frombuffer(t.nodes, "<f8").reshape(-1, 6), query_ids, np.stack(part["v"].to_list()), k, factor)
            there = np.isfinite(best.score)
            out.append(pd.DataFrame({"query_id": np.repeat(query_ids, k)[there.ravel()], "vec_id": best.id[there], "score": best.score[there]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    hits = trees.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(found, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asked: Column, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of all other vectors for every vector whose row fits `asked` (a condition on `vec_id`).

    Nearness is the largest inner product in double precision, ties to the smaller id. `factor` 1 is exact; larger
    ones prune more and may miss neighbours. Null or zero vectors, and those holding null or non-finite numbers,
    take no part; vectors of another length are no candidates for a query. Ids are meant to be unique; rows that
    repeat an id are candidates each, and one search is made for the id. An empty table gives no rows.
    """
    rows = cut(usable(vectors))
    return search(build_index(rows, shard_rows), rows.where(asked).dropDuplicates(["vec_id"]), k, factor)
