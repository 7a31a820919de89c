"""Removal of repeated byte strings: longest-previous-factor arrays over a sparse suffix order."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents_of, mix64

CHUNK_BYTES = 4 << 20
GRAM = 24
BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
ALL = np.uint32(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place, built by doubling; shorter ends are left out."""
    done, length, power = None, 0, BASE
    block, span = data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if size & span:
            done = block[: len(data) - span + 1] if done is None else done[: len(data) - length - span + 1] * power + block[length : len(data) - span + 1]
            length += span
        if span * 2 > size:
            return mix64(done)
        block = block[: len(block) - span] * power + block[span:]
        span, power = span * 2, power * power


class Anchors:
    """Places of a chunk's texts that are chosen by content alone: every string of `match` bytes holds one, at the
    same place in all its copies.

    Of the GRAM-byte strings that begin in a window, those of smallest hash are taken. A match of `match` bytes has
    `match - GRAM + 1` such beginnings, which is the window.
    """

    def __init__(self, docs: pa.Table, match: int):
        docs = docs.sort_by("doc_id")
        self.ids = docs["doc_id"].to_numpy()
        texts = docs["text"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.begins, self.match, self.window = offsets - offsets[0], match, match - GRAM + 1
        self.at, self.hash = self._chosen()
        self.doc = np.searchsorted(self.begins, self.at, "right") - 1
        # Places of the same gram, in one order that every pass over the chunk finds again.
        self.keys, self.key = np.unique(self.hash & np.uint64((1 << 48) - 1), return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.key, ids)
        np.maximum.at(high, self.key, ids)
        self.twice = low < high

    def _chosen(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.data) < self.match:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = gram_hashes(self.data)
        inside = np.zeros(len(self.data) + 1, np.int32)
        lengths = np.diff(self.begins)
        good = lengths >= self.match
        np.add.at(inside, self.begins[:-1][good], 1)
        np.add.at(inside, self.begins[1:][good] - GRAM + 1, -1)
        valid = np.cumsum(inside)[: len(hashes)] > 0
        hashes[~valid] = np.iinfo(np.uint64).max
        least = _sliding(np.minimum, hashes, self.window)
        if not len(least):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        edge = np.zeros(self.window - 1, np.uint64)
        highest = _sliding(np.maximum, np.concatenate([edge, least, edge]), self.window)
        at = np.nonzero((highest == hashes) & valid)[0]
        return at, hashes[at]

    def parts(self, parts: int) -> np.ndarray:
        return (self.keys >> np.uint64(32)).astype(np.int64) % parts

    def contexts(self, chosen: np.ndarray) -> np.ndarray:
        """The bytes around anchors in which a match that holds them can lie; two last columns say how many there
        are before and after the anchor's beginning in its text."""
        reach = self.match - GRAM
        at, doc = self.at[chosen], self.doc[chosen]
        left, right = np.minimum(reach, at - self.begins[doc]), np.minimum(self.match, self.begins[doc + 1] - at)
        places = at[:, None] + np.arange(-reach, self.match)
        there = (np.arange(-reach, self.match) >= -left[:, None]) & (np.arange(-reach, self.match) < right[:, None])
        rows = np.where(there, self.data[np.clip(places, 0, len(self.data) - 1)], 0).astype(np.uint8)
        return np.column_stack([rows, left.astype(np.uint8), right.astype(np.uint8)])


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The best of each `width` values in a row, by doubling."""
    if len(x) < width:
        return x[:0]
    done, span = x, 1
    while span * 2 <= width:
        done, span = best(done[:-span], done[span:]), span * 2
    rest = width - span
    return best(done[: len(done) - rest], done[rest:]) if rest else done


def _as_rows(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1]))).ravel()


class Candidates:
    """A chunk's anchors that other documents have too, as distinct contexts with the smallest doc_id of each."""

    def __init__(self, anchors: Anchors, shared: np.ndarray, parts: int):
        self.chosen = np.nonzero((shared | anchors.twice)[anchors.key])[0]
        part = anchors.parts(parts)[anchors.key[self.chosen]]
        rows = np.column_stack([part.astype(">u4").view(np.uint8).reshape(-1, 4), anchors.contexts(self.chosen)]) if len(part) else np.zeros((0, 4 + 2 * anchors.match - GRAM + 2), np.uint8)
        _, first, self.back = np.unique(_as_rows(rows), return_index=True, return_inverse=True) if len(rows) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.rows, self.part = rows[first, 4:], part[first]
        self.docs = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.docs, self.back, anchors.ids[anchors.doc[self.chosen]])


def previous_factors(rows: np.ndarray, docs: np.ndarray, match: int) -> np.ndarray:
    """For each distinct context a bit for every string of `match` bytes in it that a smaller document has too.

    The suffixes that begin in front of an anchor are put in order, as far as `match` bytes: a run of equal ones is
    where neighbours' common prefixes reach `match`. The previous or next smaller document in suffix order gives a
    suffix its longest previous factor; it is long enough where the smallest of the run is smaller.
    """
    reach = match - GRAM
    starts = np.arange(reach + 1)
    left, right = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    inside = (starts >= reach - left[:, None]) & (starts + match <= reach + right[:, None])
    context, start = np.nonzero(inside)
    masks = np.zeros(len(rows), np.uint32)
    if not len(context):
        return masks
    flat = np.ascontiguousarray(rows[:, :-2]).ravel()
    suffixes = np.lib.stride_tricks.sliding_window_view(flat, match)[context * (rows.shape[1] - 2) + start]
    # Suffixes can only be equal where hashes of their bytes are; the others need no place in the order.
    hashes = gram_hashes(flat, match)[context * (rows.shape[1] - 2) + start]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    met = np.zeros(len(order), bool)
    met[order[1:][same]] = met[order[:-1][same]] = True
    context, start, suffixes = context[met], start[met], suffixes[met]
    if not len(context):
        return masks
    keys = _as_rows(suffixes)
    order = np.argsort(keys, kind="stable")
    run = np.concatenate([[0], np.nonzero(keys[order][1:] != keys[order][:-1])[0] + 1])
    smallest = np.repeat(np.minimum.reduceat(docs[context[order]], run), np.diff(np.append(run, len(order))))
    earlier = smallest < docs[context[order]]
    np.bitwise_or.at(masks, context[order][earlier], np.uint32(1) << start[order][earlier].astype(np.uint32))
    return masks


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def remove_repeats(docs: DataFrame, match: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Removes each byte covered by a string of `match` bytes that also starts in a document of smaller doc_id.

    Returns `doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept` (binary) for every document. Texts are UTF-8;
    strings overlap, are judged on the input and never cross documents.

    Texts are dealt into chunks. Three passes go over them: the hashes of anchors meet by hash, which leaves those of
    more than one document; the bytes around these meet by anchor, are put in suffix order, and the answers go back;
    the last pass removes. A chunk says everything once, however many of its documents it is true of, so a passage
    that a third of all documents hold makes one row for a chunk. The texts are shuffled once: all passes use the
    same exchange.

    A null or empty text has no bytes. Rows that repeat a doc_id are judged each against smaller ids. Rows without a
    doc_id are left out, an empty table gives no rows, other columns are not read. `match` is from 25 to 55.
    """
    if not GRAM < match <= GRAM + 31:
        raise ValueError("match must be from 25 to 55")
    rows = documents_of(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    chunks = int(size // chunk_bytes) + 1
    parts = chunks
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))

    said = "part int, chunk int, n long, body binary"

    def say(table: pa.Table) -> pa.Table:
        anchors, chunk = Anchors(table, match), table["chunk"][0].as_py()
        part, low = anchors.parts(parts), (anchors.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        out = [(int(p), chunk, len(k), zlib.compress(low[k].tobytes(), 1)) for k in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1) if len(k) for p in (part[k[0]],)]
        return _table(said, out)

    def meet(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(zlib.decompress(b), np.uint32) for b in table["body"].to_pylist()]
        _, back, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        shared = np.split(counts[back] > 1, np.cumsum([len(f) for f in found])[:-1])
        return _table(said, [(p, c, len(s), np.packbits(s).tobytes()) for p, c, s in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), shared, strict=True)])

    def heard(anchors: Anchors, replies: list[tuple]) -> np.ndarray:
        part, shared = anchors.parts(parts), np.zeros(len(anchors.keys), bool)
        order = np.argsort(part, kind="stable")
        begins = np.searchsorted(part[order], np.arange(parts))
        for p, n, body in replies:
            shared[order[begins[p] : begins[p] + n]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
        return shared

    def tuples(table: pa.Table, kind: int) -> list[tuple]:
        table = table.filter(pc.equal(table["kind"], kind)) if "kind" in table.column_names else table
        return list(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["body"].to_pylist(), strict=True))

    shown = "part int, chunk int, n long, body binary, docs binary"

    def show(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(shown, [])
        anchors, chunk = Anchors(table, match), table["chunk"][0].as_py()
        found, out = Candidates(anchors, heard(anchors, tuples(replies, 0)), parts), []
        for p in np.unique(found.part):
            k = found.part == p
            out.append((int(p), chunk, int(k.sum()), zlib.compress(found.rows[k].tobytes(), 1), zlib.compress(found.docs[k].tobytes(), 1)))
        return _table(shown, out)

    def judge(table: pa.Table) -> pa.Table:
        width = 2 * match - GRAM + 2
        bodies = [np.frombuffer(zlib.decompress(b), np.uint8).reshape(-1, width) for b in table["body"].to_pylist()]
        ids = np.concatenate([np.frombuffer(zlib.decompress(d), np.int64) for d in table["docs"].to_pylist()])
        rows = np.concatenate(bodies)
        _, first, back = np.unique(_as_rows(rows), return_index=True, return_inverse=True)
        smallest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(smallest, back, ids)
        masks = np.where(ids > smallest[back], ALL, previous_factors(rows[first], smallest, match)[back]).astype(np.uint32)
        ends = np.cumsum([len(b) for b in bodies])
        return _table(said, [(p, c, len(m), zlib.compress(m.tobytes(), 1)) for p, c, m in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), np.split(masks, ends[:-1]), strict=True)])

    done = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(done, [])
        anchors = Anchors(table, match)
        found, reach = Candidates(anchors, heard(anchors, tuples(replies, 0)), parts), match - GRAM
        masks = np.zeros(len(found.docs), np.uint32)
        begins = np.searchsorted(found.part, np.arange(parts))
        for p, n, body in tuples(replies, 1):
            masks[begins[p] : begins[p] + n] = np.frombuffer(zlib.decompress(body), np.uint32)
        at, doc = anchors.at[found.chosen], anchors.doc[found.chosen]
        mask = np.where(anchors.ids[doc] > found.docs[found.back], ALL, masks[found.back])
        edges = np.zeros(len(anchors.data) + 1, np.int32)
        low, high = np.maximum(anchors.begins[doc], at - reach), np.minimum(anchors.begins[doc + 1], at + match)
        whole = (mask == ALL) & (high - low >= match)
        np.add.at(edges, low[whole], 1)
        np.add.at(edges, high[whole], -1)
        for start in range(reach + 1):
            k = (mask != ALL) & ((mask >> np.uint32(start)) & np.uint32(1)).astype(bool)
            np.add.at(edges, at[k] - reach + start, 1)
            np.add.at(edges, at[k] - reach + start + match, -1)
        gone, out = np.cumsum(edges[:-1]) > 0, []
        for i, a, b in zip(anchors.ids, anchors.begins[:-1], anchors.begins[1:], strict=True):
            g = gone[a:b]
            kept = anchors.data[a:b][~g].tobytes()
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
            out.append((int(i), int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        return _table(done, out)

    shared = dealt.groupBy("chunk").applyInArrow(say, said).groupBy("part").applyInArrow(meet, said)
    contexts = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(show, shown)
    masks = contexts.groupBy("part").applyInArrow(judge, said)
    replies = shared.withColumn("kind", F.lit(0)).union(masks.withColumn("kind", F.lit(1)))
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(remove, done)
