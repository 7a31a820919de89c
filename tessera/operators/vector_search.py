"""Nearest chunks by vector: exact, or through coarse cells, 8-bit codes and exact re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CHANNEL_K_RANGE, SearchConfig
from tessera.functions.vectors import cosine, is_embedded, norm
from tessera.operators.blockscan import FILTER_COLUMNS, FILTERS, HIT_COLUMNS, CosineScorer, best_chunks
from tessera.operators.topk import top_k
from tessera.sources.cut import cut

MAX_CELLS = 65536
# Distances held at once while a batch is assigned.
DISTANCES = 4_000_000
# The largest pool of candidates that are scored exactly.
MOST_POOLED = max(5 * CHANNEL_K_RANGE[1], CHANNEL_K_RANGE[1] + 10)
POOLED = "query_id long, chunk_id string, cell int, score double, pool int"


def exact_vector_hits(
    chunks: DataFrame, queries: DataFrame, cfg: SearchConfig = SearchConfig()
) -> DataFrame:
    """Exact cosine top-k per query; queries carry `vector`, `k` and filter lists."""
    narrow = chunks.filter(is_embedded(F.col("embedding"))).select(
        "chunk_id", *FILTER_COLUMNS, "embedding"
    )
    return best_chunks(narrow, queries, CosineScorer, cfg)


@dataclass(frozen=True)
class Cells:
    """Coarse centres of the vector space, at most MAX_CELLS rows."""

    centers: np.ndarray

    def nearest(self, vectors, n: int):
        """Column with the ids of the `n` nearest centres of unit-scaled vectors."""
        centers = self.centers
        half = (centers * centers).sum(axis=1) / 2
        n = min(n, len(centers))

        rows = max(1, DISTANCES // len(centers))

        def near(vs: list) -> list:
            matrix = np.stack([np.asarray(v, dtype=float) for v in vs])
            length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
            far = half - unit @ centers.T
            if n == 1:
                return list(far.argmin(axis=1)[:, None].astype(np.int32))
            return list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32))

        @F.pandas_udf("array<int>")
        def probe(vs: pd.Series) -> pd.Series:
            parts = [near(list(vs.iloc[i : i + rows])) for i in range(0, len(vs), rows)]
            return pd.Series([cells for part in parts for cells in part], dtype=object)

        return probe(vectors.cast("array<double>"))


def train_cells(
    vectors: DataFrame, cells: int, seed: int = 7, rounds: int = 10
) -> Cells:
    """Fits centres with k-means over all rows; at most MAX_CELLS, so that the centres stay small enough to travel."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be between 1 and {MAX_CELLS}")
    embedding = F.col("embedding").cast("array<double>")
    usable = vectors.filter(is_embedded(F.col("embedding"))).select(embedding.alias("v"))
    length = norm(F.col("v"))
    unit = usable.filter(length > 0).select(
        array_to_vector(F.transform("v", lambda x: x / length)).alias("features")
    )
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(unit)
    return Cells(np.array(model.clusterCenters()))


def mean_cells(vectors: DataFrame, label: str) -> Cells:
    """A cell for each value of a column, around the mean of its vectors' directions; at most MAX_CELLS values."""
    v = F.col("embedding").cast("array<double>")
    usable = vectors.filter(is_embedded(F.col("embedding"))).select(label, v.alias("v")).filter(norm(F.col("v")) > 0)
    unit = usable.select(label, F.posexplode(F.transform("v", lambda x: x / norm(F.col("v")))).alias("i", "x"))
    means = unit.groupBy(label, "i").agg(F.avg("x").alias("m"))
    rows = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy(label).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    return Cells(np.array([[x.m for x in r.c] for r in rows]))


def assign_cells(chunks: DataFrame, cells: Cells) -> DataFrame:
    """Adds `cell`, and `code` and `scale`: the vector's direction in 8-bit steps, a quarter of its single precision.

    Chunks without a vector of the cells' size are left out. Write the result with `write_cells`.
    """
    dim = cells.centers.shape[1]

    @F.pandas_udf("code binary, scale double")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        matrix = np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, dim))
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        scale = np.abs(unit).max(axis=1, initial=0) / 127
        steps = np.divide(unit, scale[:, None], out=np.zeros_like(unit), where=scale[:, None] > 0)
        return pd.DataFrame({"code": [row.tobytes() for row in np.rint(steps).astype(np.int8)], "scale": scale})

    usable = chunks.filter(is_embedded(F.col("embedding")) & (F.size("embedding") == dim))
    found = usable.withColumn("_coded", coded(F.col("embedding").cast("array<double>")))
    return found.withColumns({"cell": F.get(cells.nearest(F.col("embedding"), 1), F.lit(0)), "code": F.col("_coded.code"), "scale": F.col("_coded.scale")}).drop("_coded")


def write_cells(celled: DataFrame, path: str) -> DataFrame:
    """Keeps chunks with their cells in a new folder, partitioned by cell; a large cell is written by several tasks."""
    celled.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return celled.sparkSession.read.schema(celled.schema).parquet(path).select(*celled.columns)


def cell_vector_hits(
    celled: DataFrame, queries: DataFrame, cells: Cells, cfg: SearchConfig = SearchConfig()
) -> DataFrame:
    """Approximate cosine top-k in two steps.

    Queries meet the chunks of their `nprobe` nearest cells by an equi-join on `cell`; only these cells are read. A cell
    of many chunks is split into parts, the queries that probe it into tiles, so a task holds at most some
    `tile_chunks` codes and `tile_queries` vectors. It scores codes and keeps `vector_pool` candidates per query (without
    that column 5 k, at least k + 10). The best of these are fetched and scored exactly, as in the exact search.
    """
    dim = cells.centers.shape[1]
    pool = F.col("vector_pool") if "vector_pool" in queries.columns else F.greatest(5 * F.col("k"), F.col("k") + 10)
    asked = queries.filter(F.size("vector") == dim).withColumn("pool", pool.cast("int"))
    probing = cut(asked.withColumn("cell", F.explode(cells.nearest(F.col("vector"), cfg.nprobe))))
    # At most MAX_CELLS rows, whatever the chunks and queries; their cells prune the scan.
    met = celled.groupBy("cell").agg(F.count("*").alias("n")).join(probing.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = cut(met.select("cell", F.ceil(F.col("n") / cfg.tile_chunks).cast("int").alias("parts"), F.ceil(F.col("m") / cfg.tile_queries).cast("int").alias("tiles")))
    probed = [r[0] for r in sizes.select("cell").collect()]
    near = celled.filter(F.col("cell").isin(probed))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = near.join(F.broadcast(sizes), "cell").select("cell", place("chunk_id", "parts").alias("part"), every("tiles").alias("tile"), "chunk_id", *FILTER_COLUMNS, "code", "scale")
    right = probing.join(F.broadcast(sizes), "cell").select("cell", every("parts").alias("part"), place("query_id", "tiles").alias("tile"), "query_id", "pool", *FILTERS.values(), "vector")
    keys = ["cell", "part", "tile"]
    pooled = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pooled, POOLED)
    order = [F.desc("score"), F.col("chunk_id")]
    best = cut(top_k(pooled, ["query_id"], order, limit=MOST_POOLED, k="pool").select("query_id", "chunk_id", "cell"))
    found = near.select("cell", "chunk_id", "source_id", "embedding").join(best, ["cell", "chunk_id"]).join(asked.select("query_id", "k", "vector"), "query_id")
    scored = found.withColumn("score", F.round(cosine(F.col("embedding"), F.col("vector")), cfg.score_digits))
    return top_k(scored, ["query_id"], order, k="k").select(*HIT_COLUMNS)


def _pooled(chunks: pa.Table, queries: pa.Table) -> pa.Table:
    """The best `pool` chunks of a part of a cell for each query that probes it, by their codes."""
    out = {name: [] for name in ("query_id", "chunk_id", "cell", "score", "pool")}
    if chunks.num_rows and queries.num_rows:
        scale = chunks["scale"].to_numpy().astype(np.float32)
        codes = np.frombuffer(b"".join(chunks["code"].to_pylist()), np.int8).reshape(len(scale), -1) * scale[:, None]
        vectors = np.array(queries["vector"].to_pylist(), dtype=float)
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)
        scores, ids, cell = unit @ codes.T, chunks["chunk_id"].to_numpy(), chunks["cell"][0].as_py()
        values = {c: chunks[c].to_numpy() for c in FILTER_COLUMNS}
        wanted = [queries[c].to_pylist() for c in FILTERS.values()]
        for row, (query, pool) in enumerate(zip(queries["query_id"].to_pylist(), queries["pool"].to_pylist(), strict=True)):
            keep = np.ones(len(ids), bool)
            for name, lists in zip(FILTERS, wanted, strict=True):
                if lists[row]:
                    keep &= np.isin(values[name].astype(str), lists[row]) & (values[name] != None)  # noqa: E711
            at = np.flatnonzero(keep)
            if len(at) > pool:
                least = np.partition(scores[row, at], len(at) - pool)[len(at) - pool]
                at = at[scores[row, at] >= least]
                at = at[np.lexsort((ids[at], -scores[row, at]))[:pool]]
            for name, found in zip(out, ([query] * len(at), ids[at], [cell] * len(at), scores[row, at].astype(float), [pool] * len(at)), strict=True):
                out[name].extend(found)
    types = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32())
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
