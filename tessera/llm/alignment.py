"""Cross-tokenizer alignment: tokens of two tokenizers grouped by the bytes they share."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, documents_of, text_slices
from tessera.sources.cut import cut

# A block of documents is numbered and counted together; its texts are tokenised in smaller steps.
BLOCK_BYTES, STEP_BYTES = 4 << 20, 512 << 10
SPACE_MARK = "▁"
# How byte-level tokenizers usually cut words: a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Signs beyond ASCII, Latin letters and common marks, and words or gaps of a thousand signs.
UNCOMMON = re.compile(r"[^\x00-\x7f\xa1-\u024f\u2010-\u2027]|\S{1000}|\s{1000}")
# What follows a token in the written form of groups.
NEXT, OTHER_SIDE, GROUP_END = 0, 1, 2
SIGNS = (",", "|", ";")

STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCKS = f"block long, doc_id long, {STATS}, groups string, links binary, pair long, code int, docs long"
RESULT = f"doc_id long, {STATS}, groups string, n_best long, count_sum long"


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level entry: printable bytes stand for themselves, the others are numbered from 256."""
    return bytes(_BYTE_OF[ord(c)] for c in token) if all(ord(c) in _BYTE_OF for c in token) else token.encode()


def _byte_level() -> dict[int, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {256 + k: b for k, b in enumerate(others)}


_BYTE_OF = _byte_level()


class Vocabulary:
    """The bytes of every id, and the ids of whole texts; `encode` gives the ids of each of some texts."""

    def __init__(self, entries: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.entries, self.encode = pa.array(entries, pa.binary()), encode
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        ids, counts = [np.zeros(0, np.int32)], []
        for step in _steps(texts):
            lists = self.encode(step)
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32))
            counts += map(len, lists)
        return np.concatenate(ids), np.array(counts, np.int64)

    def spells(self, ids: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the bytes of each text's ids are those wanted."""
        if not len(ids):
            return np.fromiter((not w for w in want), bool, len(want))
        spelt = self.entries.take(pa.array(ids))
        at = np.frombuffer(spelt.buffers()[1], np.int32, len(ids) + 1)[np.concatenate([[0], np.cumsum(counts)])]
        data = spelt.buffers()[2].to_pybytes()
        return np.fromiter((data[a:b] == w for a, b, w in zip(at[:-1], at[1:], want, strict=True)), bool, len(want))


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in parts of some STEP_BYTES, as tokenizers need much memory for each sign."""
    step, size = [], 0
    for text in texts:
        step.append(text)
        size += len(text)
        if size >= STEP_BYTES:
            yield step
            step, size = [], 0
    if step:
        yield step


def byte_level_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE of `tokenizers`, given the text behind one space; special tokens in texts are plain text.

    Where the file's merges are in order of their ids and words are cut by the usual pattern, texts of common signs go
    through `tiktoken`, several times as fast, with the file's own entries as ranks; texts of other signs, for which the
    two may classify letters or spaces by different editions of Unicode, and very long words do not.
    """
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    entries = {i: byte_level_bytes(t) for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    usual = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not model["ignore_merges"]
    fast = None
    if usual and merged == list(range(256, 256 + len(merged))):
        fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={entries[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        found = [fast.encode_ordinary(" " + t) if fast and t and not UNCOMMON.search(t) else [] for t in texts]
        rest = [k for k, ids in enumerate(found) if texts[k] and not ids]
        for k, e in zip(rest, tokenizer.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False) if rest else [], strict=True):
            found[k] = e.ids
        return found

    return Vocabulary([entries.get(i, b"") for i in range(max(entries) + 1)], encode)


def piece_vocabulary(path: str) -> Vocabulary:
    """A sentencepiece model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(entries, lambda texts: model.encode(texts, num_threads=1))


def terminals(successor: np.ndarray) -> np.ndarray:
    """The last token that each token reaches: every pointer jumps to its target's target until none moves."""
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


class Alignment:
    """Links and groups of the tokens of many texts, which follow one another.

    Token ends cut the bytes into segments; every segment is one link, an A token and a B token that overlap. Every
    token points to its farthest-right overlapping token of the other side; where both end together, to the A token
    there, which points to itself. The token at the end of all pointers labels the group.
    """

    def __init__(self, a_ids: np.ndarray, a_lengths: np.ndarray, b_ids: np.ndarray, b_lengths: np.ndarray):
        n = int(a_lengths.sum())
        marks = np.zeros(n, np.uint8)
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        marks[a_ends - 1] = 1
        marks[b_ends - 1] += 2
        self.ends = np.flatnonzero(marks)
        kind = marks[self.ends]
        ends_a, ends_b = (kind & 1).astype(bool), kind >= 2
        self.a = np.cumsum(ends_a) - ends_a
        self.b = np.cumsum(ends_b) - ends_b
        size = len(a_ids)
        successor = np.concatenate([size + self.b[ends_a], self.a[ends_b]])
        self.last_a, self.last_b = ends_b[ends_a], ends_a[ends_b]
        successor[:size][self.last_a] = np.flatnonzero(self.last_a)
        label = terminals(successor)
        number = np.cumsum(self.last_a) - 1
        self.a_group, self.b_group = number[label[:size]], number[label[size:]]
        self.a_ids, self.b_ids = a_ids, b_ids

    def written(self, names: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All groups as text, in bytes, and the places where its tokens begin; `names` has every id with each sign behind it."""
        n_groups = int(self.last_a.sum())
        in_a, in_b = np.bincount(self.a_group, minlength=n_groups), np.bincount(self.b_group, minlength=n_groups)
        total = len(self.a_ids) + len(self.b_ids)
        parts = np.zeros(total, np.int64)
        parts[np.arange(len(self.a_ids)) + (np.cumsum(in_b) - in_b)[self.a_group]] = self.a_ids.astype(np.int64) * 3 + np.where(self.last_a, OTHER_SIDE, NEXT)
        parts[np.arange(len(self.b_ids)) + np.cumsum(in_a)[self.b_group]] = self.b_ids.astype(np.int64) * 3 + np.where(self.last_b, GROUP_END, NEXT)
        spelt = names.take(pa.array(parts))
        return memoryview(spelt.buffers()[2]), np.frombuffer(spelt.buffers()[1], np.int64, total + 1)


def _names(size: int) -> pa.Array:
    return pa.array([f"{i}{s}" for i in range(size) for s in SIGNS], pa.large_string())


def _pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs."""
    return zlib.compress(np.concatenate([np.diff(codes, prepend=0), times]).astype("<u4").tobytes(), 1)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(body), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_loaded: dict[tuple[str, str], tuple[Vocabulary, Vocabulary, pa.Array]] = {}


def _vocabularies(a_path: str, b_path: str) -> tuple[Vocabulary, Vocabulary, pa.Array]:
    if (a_path, b_path) not in _loaded:
        a, b = byte_level_vocabulary(a_path), piece_vocabulary(b_path)
        _loaded[a_path, b_path] = a, b, _names(max(len(a.entries), len(b.entries)))
    return _loaded[a_path, b_path]


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Blocks of documents: a row per document, and one per distinct linked pair of the block (`pair`, `code`, `docs`).

    A pair is A id * 2^32 + B id; `code` is its place in the block and `docs` how many of the block's documents hold it.
    `links` holds each document's codes with their occurrences.
    """

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, names = _vocabularies(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for rows in text_slices(batches, size=BLOCK_BYTES):
            texts = column(rows, "text").to_pylist()
            n = len(texts)
            (a_ids, n_a), (b_ids, n_b) = a.ids(texts), b.ids(texts)
            want = [(" " + t).encode() if t else b"" for t in texts]
            good = a.spells(a_ids, n_a, want) & b.spells(b_ids, n_b, want)
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
            begins = np.cumsum([0, *(len(w) * g for w, g in zip(want, good, strict=True))])
            found = Alignment(a_ids, a.lengths[a_ids], b_ids, b.lengths[b_ids])
            # The documents' parts of the segments, the A tokens and the written groups.
            at = np.searchsorted(found.ends, begins)
            groups = np.concatenate([[0], np.cumsum(found.last_a)])[np.concatenate([[0], np.cumsum(n_a)])]
            digests, written = [""] * n, [""] * n
            if len(a_ids):
                body, begins_of = found.written(names)
                places = begins_of[np.cumsum([0, *(n_a + n_b)])]
                for k in np.flatnonzero(good & (n_a > 0)):
                    part = body[places[k] : places[k + 1] - 1]
                    digests[k] = hashlib.sha256(part).hexdigest()
                    if keep_groups:
                        written[k] = bytes(part).decode()
            pairs, codes = np.unique((a_ids[found.a].astype(np.int64) << 32) | b_ids[found.b], return_inverse=True)
            doc = np.repeat(np.arange(n), np.diff(at))
            held, times = np.unique(doc * max(1, len(pairs)) + codes, return_counts=True)
            owner, held = np.divmod(held, max(1, len(pairs)))
            cuts = np.searchsorted(owner, np.arange(n + 1))
            links = [_pack(held[x:y], times[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = {
                "doc_id": column(rows, "doc_id").cast(pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.diff(at),
                "groups_sha256": digests, "groups": pa.array(written if keep_groups else [None] * n, pa.string()), "links": pa.array(links, pa.binary()),
            }
            yield _rows(block, n, columns)
            counts = np.bincount(held, minlength=len(pairs))
            for x in range(0, len(pairs), 1 << 16):
                y = min(len(pairs), x + (1 << 16))
                yield _rows(block, y - x, {"pair": pairs[x:y], "code": np.arange(x, y, dtype=np.int32), "docs": counts[x:y]})
            block += 1

    return documents_of(docs).mapInArrow(aligned, BLOCKS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(block: int, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of BLOCKS; columns not given are null."""
    fields = [f.split() for f in BLOCKS.split(", ")]
    columns = columns | {"block": np.full(n, block, np.int64)}
    made = [pa.nulls(n, _TYPES[t]) if k not in columns else columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], _TYPES[t]) for k, t in fields]
    return pa.record_batch(made, names=[k for k, _ in fields])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """`pair, count, best`: how many documents hold a pair, and whether no other pair of its A id has more.

    An A id's highest count is a row per id, so that table never has more rows than the vocabulary; it is broadcast.
    """
    counts = cut(blocks.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("count")))
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups` of every document.

    A text is encoded by the byte-level BPE in `a_path`, behind one space, and by the sentencepiece model in `b_path`,
    whole and without special tokens; both paths must exist where tasks run. `groups` lists the ids of each group as
    `a1,a2|b1;a3|b2,b3` where `keep_groups` is set (else null), `groups_sha256` is its digest. A link is a pair of
    overlapping tokens, its count the number of documents that hold its ids linked, `count_sum` the sum over links and
    `n_best` the links whose count is the highest of their A id, ties included.

    Texts are tokenised once. Of a block of some `BLOCK_BYTES` of text, the distinct pairs are shuffled, not those of
    each document; their counts come back to the block. A document longer than that is a block.

    Null and empty texts, and those that either tokenizer does not spell back, have zeros and an empty digest. Every
    row is a document of its own, also one that repeats a doc_id; rows without a doc_id are left out; an empty table
    gives no rows; other columns are not read.
    """
    blocks = cut(aligned_blocks(docs, a_path, b_path, keep_groups))
    replies = blocks.where("pair is not null").select("block", "code", "pair").join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "code", "count", "best")
    rows = blocks.where("pair is null").drop("pair", "code", "docs")

    def summed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        size = replies.num_rows
        code = replies["code"].to_numpy()
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[code], best[code] = replies["count"].to_numpy(), replies["best"].to_numpy()
        sums = []
        for body in rows["links"].to_pylist():
            codes, times = _unpack(body)
            sums.append((int(best[codes] @ times), int(count[codes] @ times)))
        n_best, count_sum = zip(*sums, strict=True) if sums else ((), ())
        return rows.drop_columns(["block", "links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return rows.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(summed, RESULT)
