"""Best-fit packing of tokenised documents by exact complements of length sums."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, documents_of, ragged, text_slices, word_codes
from tessera.sources.cut import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_PER_BUCKET = 4_000
CACHED_WORDS = 600_000
SLICE_BYTES = 8 << 20
SIGNS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""


class WordTokenizer:
    """Token ids of texts by a tokenizer that never joins characters over white space.

    Every distinct word is encoded once for a batch, and up to `CACHED_WORDS` words stay known for later ones.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _bytes(self, words: list[str]) -> list[bytes]:
        found = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        encoded = self.tokenizer.encode_batch_fast([words[i] for i in new], add_special_tokens=False) if new else []
        for i, e in zip(new, encoded, strict=True):
            found[i] = np.array(e.ids, "<u4").tobytes()
            if len(self.known) < CACHED_WORDS and len(words[i]) < 64:
                self.known[words[i]] = found[i]
        return found

    def _parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Words in two parts that can be encoded apart, in small letters: signs behind a letter or digit, and the rest.

        The tokenizer lowers letters itself and never joins letters or digits with signs. Words that may hold a
        special token stay as they are, and an apostrophe, which can belong to letters, is no sign here.
        """
        special = pc.match_substring(words, "<|")
        lower = pc.if_else(special, words, pc.ascii_lower(words)).cast(pa.large_string())
        core = pc.ascii_rtrim(lower, characters=SIGNS)
        ends, data = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1][1:], np.frombuffer(lower.buffers()[2], np.uint8)
        signs = (pc.binary_length(lower).to_numpy() - pc.binary_length(core).to_numpy()).astype(np.int64)
        last = data[ends - signs - 1]
        plain = ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
        signs[~plain | special.to_numpy(zero_copy_only=False)] = 0
        core = pc.if_else(pa.array(signs > 0), core, lower)
        offsets = np.concatenate([[0], np.cumsum(signs)]).astype(np.int64)
        tail = pa.LargeStringArray.from_buffers(len(signs), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ragged(ends - signs, signs)])))
        return core.dictionary_encode(), tail.dictionary_encode()

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end_id`, and the place where each text begins (one more at the end)."""
        words, codes, offsets = word_codes(text)
        core, tail = self._parts(words) if len(words) else (words.dictionary_encode(), words.dictionary_encode())
        encoded = [*self._bytes(core.dictionary.to_pylist()), *self._bytes(tail.dictionary.to_pylist()), np.array([end_id], "<u4").tobytes()]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        parts = np.column_stack([np.asarray(core.indices), np.asarray(tail.indices) + len(core.dictionary)]).ravel()
        parts = np.append(parts, len(encoded) - 1)
        flat = np.frombuffer(b"".join(encoded), "<u4")[ragged((np.cumsum(sizes) - sizes)[parts], sizes[parts])]
        sizes = np.append(sizes[parts[:-1]].reshape(-1, 2).sum(axis=1), 1)
        codes = np.insert(codes, offsets[1:], len(words))
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged((np.cumsum(sizes) - sizes)[codes], lengths)], ends[offsets + np.arange(len(offsets))]


_tokenizers: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids of every document; `tokenizer_path` must exist where tasks run."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        for rows in text_slices(batches, size=SLICE_BYTES):
            ids, begins = tokenizer.encode(column(rows, "text"), end_id)
            counts = np.diff(begins)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = ragged(np.zeros(len(counts), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = begins[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length, strict=True)]
            yield pa.record_batch(
                [pc.take(column(rows, "doc_id").cast(pa.int64()), pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(cut_up, PIECES)


def _exact(gap: int, counts: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to `gap`, long ones first."""
    if counts[gap] > 0:
        return (gap,)
    there = counts > 0

    def pair(g: int, taken: int = 0) -> tuple[int, int] | None:
        low = np.arange(1, g // 2 + 1)
        fits = low[there[low] & there[g - low]]
        for a in fits:
            need = Counter([a, g - a]) + Counter([taken] * bool(taken))
            if all(counts[k] >= n for k, n in need.items()):
                return int(g - a), int(a)
        return None

    if found := pair(gap):
        return found
    for a in np.nonzero(there[: max(gap - 1, 0)])[0][::-1]:
        if found := pair(gap - int(a), int(a)):
            return int(a), *found
    return None


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; every piece of the histogram is used once.

    From the longest length down, gaps are closed exactly by single lengths, pairs or triples while enough pieces
    of each are left; what has no exact complement is packed best-fit. Each step uses up all pieces of a length or
    all complements, so work and patterns depend on the number of lengths, not on the number of pieces.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    patterns = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0

    def use(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(int(counts[k]) // n for k, n in need.items())
        patterns.append((pattern, times))
        for k, n in need.items():
            counts[k] -= n * times

    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            found = _exact(capacity - length, counts)
            counts[length] += 1
            if not found:
                break
            use((length, *found))
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            pattern, left = [length], counts.copy()
            left[length] -= 1
            gap = capacity - length
            while gap and (fits := np.nonzero(left[: gap + 1])[0]).size:
                pattern.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
            use(tuple(pattern))
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first ordinal, first sequence, offset), sorted: where its pieces go in their order."""
    at: dict[int, list] = {}
    used, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            at.setdefault(length, []).append((used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    return {k: np.array(v, np.int64) for k, v in at.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents into few sequences: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    A document's ids end with `end_id`; only documents longer than `capacity` are cut. The driver sees only the
    histogram of lengths (at most `capacity` numbers) and plans patterns of lengths; tasks then number the pieces
    of each length, in buckets so that a common length is no single task's work, and look their places up.

    A null or empty text is one piece of `end_id`. Rows without a doc_id are left out, repeated rows are packed
    each on its own, an empty table gives no rows, other columns are not read.
    """
    pieces = cut(token_pieces(documents_of(docs), tokenizer_path, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(pack_lengths(histogram, capacity), capacity)
    buckets = sum(histogram.values()) // PIECES_PER_BUCKET + 1
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counted = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    until = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("length", "bucket", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keys))
    rows = rows.withColumn("number", number).join(counted, ["length", "bucket"])
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("number") - 1).alias("ordinal"))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for length, at in rows.groupby("length").indices.items():
                ordinal, slots = rows["ordinal"].to_numpy()[at], where[length]
                slot = slots[np.searchsorted(slots[:, 0], ordinal, "right") - 1]
                sequence[at], offset[at] = slot[:, 1] + ordinal - slot[:, 0], slot[:, 2]
            yield rows.drop(columns="ordinal").assign(sequence_id=sequence, offset=offset)

    return rows.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
