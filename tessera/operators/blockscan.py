"""Scoring every chunk against every query of a batch, keeping only the best per query.

Spark partitions the chunks. Each task scores its Arrow batches against a block of queries
and keeps a running top-k per query, so a task emits at most k rows per query and no
query/chunk pair is ever written out or shuffled beyond that.

The block of queries is sent to the tasks only while its size is inside the configured
bound. A larger batch of queries is tiled instead: chunk parts and query tiles meet in a
co-grouped shuffle whose groups have a bounded size, and run through the same scoring code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.operators.topk import top_k

FILTER_COLUMNS = ("domain", "source_id", "version")
FILTERS = {"domain": "domains", "source_id": "source_ids", "version": "versions"}
OUT = pa.schema(
    [
        ("query_id", pa.int64()),
        ("chunk_id", pa.string()),
        ("source_id", pa.string()),
        ("score", pa.float64()),
        ("k", pa.int32()),
    ]
)
OUT_DDL = "query_id bigint, chunk_id string, source_id string, score double, k int"
HIT_COLUMNS = ["query_id", "chunk_id", "source_id", "score", "rank"]
SUB_BLOCK = 256


@dataclass
class QueryBlock:
    """A bounded set of queries in task memory."""

    ids: np.ndarray
    k: np.ndarray
    filters: list[tuple]
    scorer: object


def _filters_of(table: pa.Table) -> list[tuple]:
    columns = [table.column(c).to_pylist() for c in FILTERS.values()]
    return [tuple(tuple(sorted(v or ())) for v in row) for row in zip(*columns)]


def make_block(table: pa.Table, scorer_of, digits: int) -> QueryBlock:
    return QueryBlock(
        ids=table.column("query_id").to_numpy(),
        k=table.column("k").to_numpy().astype(int),
        filters=_filters_of(table),
        scorer=scorer_of(table, digits),
    )


class CosineScorer:
    """Cosine similarity as one matrix product per batch; unusable vectors score 0.0."""

    column = "embedding"

    def __init__(self, table: pa.Table, digits: int):
        self.digits = digits
        vectors = [np.asarray(v if v is not None else [], dtype=float) for v in table.column("vector").to_pylist()]
        self.dims = np.array([len(v) for v in vectors])
        self.by_dim = {}
        for dim in set(self.dims) - {0}:
            rows = np.flatnonzero(self.dims == dim)
            self.by_dim[dim] = (rows, self._unit(np.stack([vectors[i] for i in rows])))

    @staticmethod
    def _unit(matrix: np.ndarray) -> np.ndarray:
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)

    def usable(self, column: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False))

    def scores(self, column: pa.Array, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(queries), len(rows)))
        taken = column.take(pa.array(rows))
        lengths = np.asarray(pc.list_value_length(taken))
        place = {q: i for i, q in enumerate(queries)}
        for dim in set(lengths):
            if dim not in self.by_dim:
                continue
            at = np.flatnonzero(lengths == dim)
            flat = taken.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            chunks = self._unit(flat.astype(float).reshape(len(at), dim))
            ids, units = self.by_dim[dim]
            wanted = [i for i, q in enumerate(ids) if q in place]
            if wanted:
                target = [place[ids[i]] for i in wanted]
                out[np.ix_(target, at)] = units[wanted] @ chunks.T
        return np.round(out, self.digits)

    keep_zero = True


def rows_at_once(queries: int) -> int:
    """Chunks scored together, fewer for larger blocks, so that the summed entries stay small."""
    return max(1, min(256, 50_000 // max(1, queries)))


class TermTable:
    """Which queries hold a term and with what weight, as flat arrays (memory follows the entries)."""

    def __init__(self, entries: list[list[tuple[str, float]]]):
        rows = sorted((t, q, w) for q, pairs in enumerate(entries) for t, w in pairs)
        self.terms = sorted({t for t, _, _ in rows})
        self.queries = np.array([q for _, q, _ in rows], dtype=np.int64)
        self.weights = np.array([w for _, _, w in rows], dtype=float)
        place = {t: i for i, t in enumerate(self.terms)}
        sizes = np.bincount([place[t] for t, _, _ in rows], minlength=len(self.terms)) if rows else np.zeros(0, int)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def add_up(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_rows: int, n_queries: int) -> np.ndarray:
        """Matrix (row, query) of the sums of value * weight over the given (row, term) pairs."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        shift = np.repeat(self.starts[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        entry = np.arange(sizes.sum()) + shift if len(terms) else np.zeros(0, np.int64)
        cell = np.repeat(rows, sizes) * n_queries + self.queries[entry]
        added = np.repeat(values, sizes) * self.weights[entry]
        return np.bincount(cell, added, n_rows * n_queries).reshape(n_rows, n_queries)


class PhraseScorer:
    """Substring scores: 3 for the whole query, 1 per query token, 2 for an equal tag.

    All tokens of all queries are looked up in one pass over the text. The whole query can
    only occur where all its tokens do, so only those rows are checked for it.
    """

    column = "text_lc"
    keep_zero = False

    def __init__(self, table: pa.Table, digits: int):
        import ahocorasick

        self.texts = table.column("query_lc").to_pylist()
        self.step = rows_at_once(len(self.texts))
        lists = [t or [] for t in table.column("tokens").to_pylist()]
        self.table = TermTable([[(t, ts.count(t)) for t in set(ts)] for ts in lists])
        self.total = np.array([len(ts) for ts in lists], dtype=float)
        self.finder = None
        if self.table.terms:
            self.finder = ahocorasick.Automaton()
            for i, token in enumerate(self.table.terms):
                self.finder.add_word(token, i)
            self.finder.make_automaton()
        self.equal = {}
        for q, text in enumerate(self.texts):
            self.equal.setdefault(text, []).append(q)

    def usable(self, column: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.not_equal(column, ""), False))

    def bind(self, batch: pa.RecordBatch) -> None:
        self.tags = batch.column(batch.schema.get_field_index("tags_lc"))

    def scores(self, column: pa.Array, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        parts = [self._rows(column, rows[i : i + self.step]) for i in range(0, len(rows), self.step)]
        return np.concatenate(parts)[:, queries].T

    def _rows(self, column: pa.Array, rows: np.ndarray) -> np.ndarray:
        texts = column.take(pa.array(rows)).to_pylist()
        tags = self.tags.take(pa.array(rows)).to_pylist()
        found = [{i for _, i in self.finder.iter(t)} if self.finder else set() for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        terms = np.array([i for f in found for i in f], dtype=np.int64)
        out = self.table.add_up(owner, terms, np.ones(len(terms)), len(texts), len(self.texts))
        for r, q in np.argwhere(out == self.total):
            if self.texts[q] in texts[r]:
                out[r, q] += 3
        for r, own in enumerate(tags):
            for q in {q for tag in own or () for q in self.equal.get(tag, ())}:
                out[r, q] += 2
        return out


class Best:
    """Running top-k per query; ties go to the smaller chunk id."""

    def __init__(self, block: QueryBlock):
        self.block = block
        self.kept = [[] for _ in block.ids]
        self.floor = np.full(len(block.ids), -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, sources: np.ndarray) -> None:
        k = self.block.k[query]
        at = np.flatnonzero(scores >= self.floor[query])
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= least]
        if not len(at):
            return
        kept = self.kept[query]
        kept.extend(zip((-scores[at]).tolist(), ids[at].tolist(), sources[at].tolist()))
        kept.sort()
        del kept[k:]
        if len(kept) == k:
            self.floor[query] = -kept[-1][0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        sizes = [len(kept) for kept in self.kept]
        if sum(sizes):
            flat = [hit for kept in self.kept for hit in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(self.block.ids, sizes), pa.int64()),
                    pa.array([chunk for _, chunk, _ in flat], pa.string()),
                    pa.array([source for _, _, source in flat], pa.string()),
                    pa.array([-s for s, _, _ in flat], pa.float64()),
                    pa.array(np.repeat(self.block.k, sizes), pa.int32()),
                ],
                schema=OUT,
            )


def _score_batch(batch: pa.RecordBatch, block: QueryBlock, best: Best) -> None:
    scorer = block.scorer
    column = batch.column(batch.schema.get_field_index(scorer.column))
    usable = scorer.usable(column)
    if not usable.any():
        return
    if hasattr(scorer, "bind"):
        scorer.bind(batch)
    ids, sources = [
        pc.fill_null(batch.column(batch.schema.get_field_index(name)), "").to_numpy(zero_copy_only=False)
        for name in ("chunk_id", "source_id")
    ]
    every, rows = np.arange(len(block.ids)), np.flatnonzero(usable)
    allowed = {}

    def passes(wanted: tuple) -> np.ndarray | None:
        if wanted not in allowed:
            mask = None
            for name, values in zip(FILTERS, wanted):
                if values:
                    column = batch.column(batch.schema.get_field_index(name))
                    hit = np.asarray(pc.is_in(column, value_set=pa.array(values, pa.string())))
                    mask = hit if mask is None else mask & hit
            allowed[wanted] = mask
        return allowed[wanted]

    for start in range(0, len(every), SUB_BLOCK):
        part = every[start : start + SUB_BLOCK]
        for q, scores in zip(part, scorer.scores(column, rows, part)):
            keep = np.ones(len(rows), bool) if scorer.keep_zero else scores > 0
            mask = passes(block.filters[q])
            if mask is not None:
                keep &= mask[rows]
            if keep.all():
                best.add(q, scores, ids[rows], sources[rows])
            elif keep.any():
                best.add(q, scores[keep], ids[rows[keep]], sources[rows[keep]])


def bounded(queries: DataFrame, cfg: SearchConfig) -> pa.Table | None:
    """The query batch as a table when it is inside the size bound, else None."""
    head = queries.limit(cfg.block_queries + 1).toArrow()
    if head.num_rows > cfg.block_queries or head.nbytes > cfg.block_bytes:
        return None
    return head


def _pushed(chunks: DataFrame, table: pa.Table) -> DataFrame:
    """Adds a scan filter when every query of the batch constrains the same column."""
    for name, queried in FILTERS.items():
        lists = table.column(queried).to_pylist()
        if lists and all(lists):
            values = sorted({v for vs in lists for v in vs})
            if len(values) <= 500:
                chunks = chunks.filter(F.col(name).isin(values))
    return chunks


def best_chunks(
    chunks: DataFrame, queries: DataFrame, scorer_of, cfg: SearchConfig, table: pa.Table | None = None
) -> DataFrame:
    """Top-k chunks per query with rank (query_id, chunk_id, source_id, score, rank).

    `queries` holds query_id, k, domains, source_ids, versions (empty list: no constraint) and the
    columns the scorer reads; `chunks` holds chunk_id, the filter columns and the scored column.
    `table` is the same batch of queries when the caller has already found it to be bounded.
    """
    digits = cfg.score_digits
    if table is None:
        table = bounded(queries, cfg)
    if table is not None:
        sent = chunks.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = make_block(sent.value, scorer_of, digits)
            best = Best(block)
            for batch in batches:
                if batch.num_rows and len(block.ids):
                    _score_batch(batch, block, best)
            yield from best.rows()

        found = _pushed(chunks, table).mapInArrow(run, OUT_DDL)
    else:
        found = _tiled(chunks, queries, scorer_of, cfg)
    order = [F.desc("score"), F.col("chunk_id")]
    return top_k(found, ["query_id"], order, k="k").select(*HIT_COLUMNS)


def _tiled(chunks: DataFrame, queries: DataFrame, scorer_of, cfg: SearchConfig) -> DataFrame:
    digits = cfg.score_digits
    tiles = max(1, -(-queries.count() // cfg.tile_queries))
    parts = max(1, -(-chunks.count() // cfg.tile_chunks))
    left = chunks.withColumn(
        "_part", F.pmod(F.xxhash64("chunk_id", "source_id"), F.lit(parts)).cast("int")
    ).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = queries.withColumn(
        "_tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")
    ).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(some_chunks: pa.Table, some_queries: pa.Table) -> pa.Table:
        if not some_chunks.num_rows or not some_queries.num_rows:
            return OUT.empty_table()
        block = make_block(some_queries.combine_chunks(), scorer_of, digits)
        best = Best(block)
        for batch in some_chunks.combine_chunks().to_batches():
            _score_batch(batch, block, best)
        return pa.Table.from_batches(list(best.rows()), schema=OUT)

    keys = ["_part", "_tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, OUT_DDL)
