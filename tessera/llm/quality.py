"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import column, documents_of, mix64, text_hashes, text_slices, word_codes
from tessera.sources.cut import cut

BITS = 18
# Texts whose n-grams are in memory at once; they take some 75 times as much.
SLICE_BYTES = 1 << 20
SAMPLE_ROWS = 16_000
SHARDS, EPOCHS = 8, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
# What the shares of a kind of n-gram sum to, and the value of the bias.
SCALE, BIAS = 4.0, 0.3
# Places that words, and the shapes of words, have in the n-grams.
WORD_GRAMS, SHAPE_GRAMS = (1, 2), (1, 2, 3)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of each text: feature numbers, values, and each text's first feature (one more at the end).

    N-grams are taken over words and over their shapes (runs of letters, capitals or digits become one sign; a word
    that repeats the one before it has a shape of its own), so words never seen before still say something. Each of
    the five kinds of n-gram contributes its shares of the text, summing to SCALE; no words, no features.
    """
    words, codes, offsets = word_codes(text)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(offsets), np.int64)
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{L}[\p{L}\p{M}]*", "a"), (r"[0-9]+", "0"), (r"(?:Aa)", "B")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    again = np.concatenate([[False], codes[1:] == codes[:-1]]) & ~first
    plain, drawn = text_hashes(words)[codes], text_hashes(shape)[codes]
    drawn[again] = np.uint64(1)
    keys, rows, kinds = [], [], []
    place = np.arange(len(codes)) - offsets[row]
    for kind, (hashes, n) in enumerate([(plain, n) for n in WORD_GRAMS] + [(drawn, n) for n in SHAPE_GRAMS]):
        h = np.full(len(codes), kind + 1, np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(31) + np.roll(hashes, k))
        there = place >= n - 1
        keys.append((h[there] >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[there])
        kinds.append(np.full(int(there.sum()), kind, np.int8))
    keys, rows, kinds = np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds)
    order = np.argsort(rows, kind="stable")
    keys, rows, kinds = keys[order], rows[order], kinds[order]
    lengths = np.diff(offsets)
    grams = np.array([*WORD_GRAMS, *SHAPE_GRAMS])
    weights = 1 / np.maximum(1, lengths[rows] - grams[kinds] + 1) * SCALE
    return keys, weights, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lengths)))])


def train_shard(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after `epochs` passes of per-coordinate FTRL-proximal updates."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in examples:
            wi = -(z[index] - np.sign(z[index]) * L1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)
            wi[np.abs(z[index]) <= L1] = 0
            g = (1 / (1 + np.exp(-np.clip(wi @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * wi
            n[index] += g * g
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from labelled documents: `labels` has `doc_id` and `label` (0 or 1, others ignored).

    About `sample_rows` labels, chosen by a hash of the id, are used; that bound lets them be broadcast. They are
    dealt over a fixed number of shards; each shard is trained on its own and the weights are averaged, so at most
    SHARDS vectors of 2^BITS + 1 numbers reach the driver. No labels: all weights are 0, every score one half.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = cut(known)
    share = min(1.0, sample_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    chosen = known.where(draw < F.lit(int(share * (1 << 20))))
    rows = documents_of(docs).join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE_BYTES):
            keys, values, begins = features(column(batch, "text"))
            found = []
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                index, back = np.unique(keys[a:b], return_inverse=True)
                found.append((index.astype("<i4").tobytes(), np.bincount(back, values[a:b], len(index)).astype("<f4").tobytes()))
            yield pa.record_batch(
                [column(batch, "doc_id").cast(pa.int64()), column(batch, "label").cast(pa.int32()), pa.array([i for i, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())],
                names=["doc_id", "label", "keys", "shares"],
            )

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        # A text can stand in the table more than once; sorting makes the order of the updates the same in any run.
        shard = shard.sort_values(["turn", "doc_id", "keys"], kind="stable")
        examples = [
            (np.append(np.frombuffer(k, "<i4"), 1 << BITS), np.append(np.frombuffer(v, "<f4").astype(float), BIAS), y)
            for k, v, y in zip(shard["keys"], shard["shares"], shard["label"], strict=True)
        ]
        return pd.DataFrame({"n": [len(examples)], "weights": [train_shard(examples).astype("<f8").tobytes()]})

    shards = rows.mapInArrow(vectors, "doc_id long, label int, keys binary, shares binary")
    shards = shards.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS))).withColumn("turn", F.xxhash64(F.lit("turn"), "doc_id"))
    fitted = shards.groupBy("shard").applyInPandas(fit, "n long, weights binary").collect()
    total = sum(r["n"] for r in fitted)
    weights = np.zeros((1 << BITS) + 1)
    for r in sorted(fitted, key=lambda r: bytes(r["weights"])):
        weights += np.frombuffer(r["weights"], "<f8") * (r["n"] / total)
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`doc_id, score` of every document: a sparse dot product of its whole text, through the logistic function.

    A null or empty text has no features and gets the score of the bias alone. Rows without a doc_id are left out,
    repeated rows are scored each, an empty table gives no rows, other columns are not read.
    """
    return with_score(documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, "score").select("doc_id", "score")


def with_score(docs: DataFrame, weights: np.ndarray, name: str) -> DataFrame:
    """All rows and columns of `docs` with the score of their texts in the column `name`, which must be free."""
    weights = weights.astype(np.float32)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE_BYTES):
            keys, values, begins = features(column(batch, "text"))
            sums = np.concatenate([[0.0], np.cumsum(weights[keys] * values)])
            logits = sums[begins[1:]] - sums[begins[:-1]] + BIAS * float(weights[-1])
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35)))))

    return docs.mapInArrow(scores, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0
