"""Ranked lexical search: best-first document intervals bounded by range maxima over posting lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, documents_of, ragged, text_slices, word_codes
from tessera.sources.cut import cut

# Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A shard of the index holds the documents of about so much text; items are searched in blocks of about so many.
SHARD_BYTES, BLOCK_ITEMS = 8 << 20, 512
# Shards whose posting lists for a block's terms have about so many bytes are searched together.
BUCKET_BYTES = 2 << 20
# Intervals of so few documents are scored as a whole, and so many intervals are taken from the queue at a time.
LEAF, WIDTH = 24, 64

INDEX = "shard long, term string, df long, total long, docs binary, tfs binary"
FOUND = "item_id long, item_key long, doc_id long, score long"


def _lowered() -> bytes:
    """Every byte as terms have it: other signs become a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


LOWERED = _lowered()


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), 0))


def _term_texts(text: pa.Array) -> pa.Array:
    """The texts with a space for every sign that belongs to no term, and in small letters."""
    text = text.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = (text.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])].to_pybytes().translate(LOWERED)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(data))


def _binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """One binary value for each part of `values`; `begins` has one place more than there are parts."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins * width), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of an inverted index over all documents with a term, of the columns in INDEX.

    A row per shard and term: its documents (places in the shard, which is in order of doc_id) and occurrences. A row
    without a term holds the shard's documents: their ids, their lengths in terms, and the sum of those in `total`.
    """

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for rows in text_slices(batches, size=SHARD_BYTES):
            words, codes, offsets = word_codes(_term_texts(column(rows, "text")))
            lengths, ids = np.diff(offsets), column(rows, "doc_id").cast(pa.int64()).to_numpy()
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            order = full[np.argsort(ids[full], kind="stable")]
            place = np.zeros(len(ids), np.int64)
            place[order] = np.arange(len(order))
            keys, tfs = np.unique(codes * len(order) + np.repeat(place, lengths), return_counts=True)
            term, doc = np.divmod(keys, len(order))
            begins = np.searchsorted(term, np.arange(len(words) + 1))
            yield _index_rows(shard, pa.nulls(1, pa.string()), np.array([len(order)]), int(lengths.sum()), _binaries(ids[order].astype("<i8"), np.array([0, len(order)])), _binaries(lengths[order].astype("<i8"), np.array([0, len(order)])))
            for a in range(0, len(words), 1 << 15):
                b = min(len(words), a + (1 << 15))
                part = slice(begins[a], begins[b])
                yield _index_rows(shard, words.slice(a, b - a).cast(pa.string()), np.diff(begins[a : b + 1]), 0, _binaries(doc[part].astype("<i4"), begins[a : b + 1] - begins[a]), _binaries(tfs[part].astype("<i4"), begins[a : b + 1] - begins[a]))
            shard += 1

    return documents_of(docs).mapInArrow(shards, INDEX)


def _index_rows(shard: int, terms: pa.Array, df: np.ndarray, total: int, docs: pa.Array, tfs: pa.Array) -> pa.RecordBatch:
    n = len(terms)
    return pa.record_batch([pa.array(np.full(n, shard)), terms, pa.array(df.astype(np.int64)), pa.array(np.full(n, total)), docs, tfs], names=["shard", "term", "df", "total", "docs", "tfs"])


class Postings:
    """Posting lists of impacts over documents in order of their ids, with one sparse table of range maxima.

    All lists stand in one array, by term and document; ranges never leave a list, so one table serves them all.
    Level j holds, for every place, the place of the largest impact among the 2^j from there on.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.argsort(term * n_docs + doc, kind="stable")
        self.keys, self.impact, self.n_docs = (term * n_docs + doc)[order], impact[order], n_docs
        self.doc = doc[order]
        self.begins = np.searchsorted(self.keys, np.arange(n_terms + 1) * n_docs)
        size = len(self.keys)
        levels = max(1, int(np.diff(self.begins).max(initial=1)).bit_length())
        self.table = np.zeros((levels, size + 1), np.int32)
        self.table[0, :size] = np.arange(size)
        for j in range(1, levels):
            half, last = 1 << (j - 1), size - (1 << j) + 1
            left, right = self.table[j - 1, :last], self.table[j - 1, half : half + last]
            self.table[j, :last] = np.where(self.impact[left] >= self.impact[right], left, right)
        self.impact = np.append(self.impact, 0)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The places of the largest impacts in the ranges [low, high); empty ones give the place behind all, of impact 0."""
        length = high - low
        level = np.frexp(np.maximum(length, 1))[1] - 1
        left = self.table[level, low]
        right = self.table[level, np.maximum(high - (1 << level.astype(np.int64)), low)]
        found = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(length > 0, found, len(self.keys))

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best documents of score above 0, best first, ties by document.

        An interval of documents is a range in each of the item's lists; the sum of their maxima bounds every score
        in it. Intervals are taken by their bound, highest first and some at a time. One of many documents is split
        at the document of its largest impact, which is scored by itself; one of few is scored whole. Intervals
        that can hold no better document than the k-th are dropped.
        """
        offset = (terms * self.n_docs)[:, None]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.begins[terms][:, None], self.begins[terms + 1][:, None]
        first, last = np.zeros(1, np.int64), np.full(1, self.n_docs)
        top = self.maxima(low, high)
        while len(first):
            bound = self.impact[top].sum(axis=0)
            least, tie = (scores[-1], docs[-1]) if len(docs) == k else (0, -1)
            open_ = (bound > least) | ((bound == least) & (first < tie))
            taken = np.flatnonzero(open_)
            if len(taken) > WIDTH:
                taken = taken[np.argpartition(-bound[taken], WIDTH)[:WIDTH]]
            if not len(taken):
                break
            open_[taken] = False
            small = last[taken] - first[taken] <= LEAF
            leaf, inner = taken[small], taken[~small]
            found = [(docs, scores)]
            if len(leaf):
                found.append(self._whole(low[:, leaf], high[:, leaf]))
            split = top[:, inner]
            middle = self.doc[split[self.impact[split].argmax(axis=0), np.arange(len(inner))]]
            at = np.searchsorted(self.keys, offset + middle)
            hit = (at < high[:, inner]) & (self.keys[np.minimum(at, len(self.keys) - 1)] == offset + middle)
            found.append((middle, np.where(hit, self.impact[at], 0).sum(axis=0)))
            docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((docs, -scores))
            docs, scores = docs[order[:k]], scores[order[:k]]
            # What is left: intervals not taken, and both sides of the split ones.
            children_low, children_high = np.hstack([low[:, inner], at + hit]), np.hstack([at, high[:, inner]])
            begin, end = np.concatenate([first[inner], middle + 1]), np.concatenate([middle, last[inner]])
            some = begin < end
            children_low, children_high = children_low[:, some], children_high[:, some]
            low, high = np.hstack([low[:, open_], children_low]), np.hstack([high[:, open_], children_high])
            top = np.hstack([top[:, open_], self.maxima(children_low, children_high)])
            first, last = np.concatenate([first[open_], begin[some]]), np.concatenate([last[open_], end[some]])
        return docs, scores

    def _whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents of the intervals, which do not overlap, with their scores."""
        places = ragged(low.ravel(), (high - low).ravel())
        docs, back = np.unique(self.doc[places], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, back, self.impact[places])
        return docs, scores


def _merged(table: pa.Table, n: int, total: int) -> tuple[dict[str, int], np.ndarray, Postings]:
    """Numbers of the terms, ids of the documents in ascending order, and postings, of the shards in one group."""
    is_term = np.array([t is not None for t in table["term"].to_pylist()])
    shards, docs, tfs = table["shard"].to_numpy(), table["docs"].to_pylist(), table["tfs"].to_pylist()
    listed = np.flatnonzero(~is_term)
    ids = [np.frombuffer(docs[k], "<i8") for k in listed]
    lengths = np.concatenate([np.frombuffer(tfs[k], "<i8") for k in listed])
    base = dict(zip(shards[listed].tolist(), np.cumsum([0, *map(len, ids)])[:-1].tolist(), strict=True))
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    rows = np.flatnonzero(is_term)
    names = table["term"].to_pylist()
    weights, number = table["weight"].to_numpy(zero_copy_only=False), {}
    lists = [np.frombuffer(docs[k], "<i4") for k in rows]
    sizes = np.array([len(x) for x in lists], np.int64)
    term = np.repeat(np.array([number.setdefault(names[k], len(number)) for k in rows], np.int64), sizes)
    weight = np.repeat(weights[rows].astype(np.int64), sizes)
    doc = np.concatenate([x + np.int64(base[shards[k]]) for k, x in zip(rows, lists, strict=True)] or [np.zeros(0, np.int64)])
    tf = np.concatenate([np.frombuffer(tfs[k], "<i4") for k in rows] or [np.zeros(0, np.int32)]).astype(np.int64)
    m = 100 - 90 + (90 * lengths[doc] * n) // total
    impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
    return number, ids[order], Postings(term, place[doc], impact, len(number), len(ids))


def search(index: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """`item_id, rank, doc_id, score`: each item's k best documents of score above 0, ties by doc_id.

    `index` is a written result of `build_index`. A term weighs floor(1000 * ln((2N+2) / (2df+1))); a document scores
    the sum of weight * ((10^9 tf) div (1000 tf + 8m)), with m = 10 + (90 n N) div L, in whole numbers.

    Only the lists of the items' terms are read. Items go in blocks of some `BLOCK_ITEMS` to every bucket of shards;
    each bucket returns k documents per item. Rows repeating an item count once; different texts of one item_id are
    items of their own (ranked apart); items without an id or a term have no rows, nor has an empty index.
    """
    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), terms_of(F.col("text")).alias("terms"))
    known = cut(known.where(F.size("terms") > 0).dropDuplicates(["item_id", "item_key"]))
    n, total = index.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    blocks = -(-known.count() // BLOCK_ITEMS)
    if not n or not blocks:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    block = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(blocks)).cast("int").alias("block")
    wanted = cut(known.select(block, F.explode("terms").alias("term")).distinct())
    lists = cut(index.where("term is not null").join(wanted.select("term").distinct(), "term", "left_semi"))
    ratio = F.lit(2 * n + 2).cast("double") / (2 * F.sum("df") + 1)
    weights = lists.groupBy("term").agg(F.floor(1000 * F.ln(ratio)).cast("long").alias("weight")).where("weight > 0")
    size = lists.agg(F.sum(F.octet_length("docs"))).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1
    bucket = F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("int").alias("bucket")
    terms = lists.join(wanted.join(weights, "term"), "term").select("block", bucket, "shard", "term", "weight", "docs", "tfs")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    shards = index.where("term is null").select(every, bucket, "shard", "term", F.lit(0).cast("long").alias("weight"), "docs", "tfs")
    asked = known.select(block, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "item_id", "item_key", "terms")

    def hits(asked: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and table.num_rows:
            number, ids, postings = _merged(table, n, total)
            for item, key, words in zip(*(asked[c].to_pylist() for c in ("item_id", "item_key", "terms")), strict=True):
                codes = np.array([number[w] for w in words if w in number], np.int64)
                if len(codes):
                    docs, scores = postings.best(codes, k)
                    out += [(item, key, int(d), int(s)) for d, s in zip(ids[docs], scores, strict=True)]
        return pa.table(dict(zip(("item_id", "item_key", "doc_id", "score"), map(list, zip(*out, strict=True)) if out else [[]] * 4, strict=True)), pa.schema([(c, pa.int64()) for c in ("item_id", "item_key", "doc_id", "score")]))

    found = asked.groupBy("block", "bucket").cogroup(shards.unionByName(terms).groupBy("block", "bucket")).applyInArrow(hits, FOUND)
    order = Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, see `search`, over an index of all `docs` made for this run.

    Every row is a document of its own, also one that repeats a doc_id; null and empty texts have no terms and are
    never found; rows without a doc_id are left out; texts are indexed whole; other columns are not read.
    """
    return search(cut(build_index(docs)), items, k)
