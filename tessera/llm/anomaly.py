"""Quality rules: statistics of rules over whole texts, and an isolation forest that finds documents unlike the others."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, documents_of, mix64, text_slices, word_codes
from tessera.sources.cut import cut

SYMBOLS, MARKS = b"#*$%&|<>", b"!?"
# Words of a window that must occur again.
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_capitals", "n_marks")
# Base rules: fewest words, and the largest share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATS = 10, 20
# The forest: trees, rows per tree, depth, and the bound of labelled rows it is fitted on.
TREES, ROWS_PER_TREE, DEPTH, SAMPLE_ROWS = 128, 256, 10, 16_384
# By how much of a feature's whole range a split may lie beyond the rows of its node.
BEYOND = 0.25
# Rules' shares are drawn towards 0 by so many words (signs, lines), as they say little in short texts.
CALM_WORDS, CALM_CHARS, CALM_LINES = 10.0, 60.0, 4.0
BINS = 1000


def _kinds() -> np.ndarray:
    """What each byte counts for: words' signs, symbols, signs, capitals, other marks; later bytes of a sign count for nothing."""
    table = np.zeros((256, 5), np.int64)
    first = [b for b in range(256) if b & 0xC0 != 0x80]
    table[[b for b in first if b != 32 and not 9 <= b <= 13], 0] = 1
    table[list(SYMBOLS), 1] = 1
    table[first, 2] = 1
    table[list(range(65, 91)), 3] = 1
    table[list(MARKS), 4] = 1
    return table


KINDS = _kinds()


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that occur twice or more in it, the first occurrence included.

    Windows are compared by 64-bit hashes of their words' codes and their text.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(offsets[row + 1] - np.arange(len(codes)) >= window)
    if not len(whole):
        return np.zeros(len(offsets) - 1, np.int64)
    h = mix64(row[whole].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        h = mix64(h * np.uint64(31) + codes[whole + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int32)
    edges[whole[again]] += 1
    edges[whole[again] + window] -= 1
    return _per_text(np.cumsum(edges)[:-1] > 0, offsets)


def repeated_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and those with a word that equal an earlier one."""
    lists = pc.split_pattern(text, "\n")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    lines = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    worded = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    coded = lines.dictionary_encode()
    keys = row[worded] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)[worded].astype(np.int64)
    distinct = np.unique(keys) // max(1, len(coded.dictionary))
    n = len(text)
    return np.diff(offsets), np.bincount(row[worded], minlength=n) - np.bincount(distinct, minlength=n)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id` and the counts in STATISTICS of every document's whole text (null: none).

    Words are runs of anything but ASCII white space; signs are code points; capitals are A to Z. Rows without a doc_id
    are left out, rows that repeat one are counted each; other columns are not read.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            text = column(rows, "text").cast(pa.large_string())
            _, codes, offsets = word_codes(text)
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            signs = [_per_text(KINDS[:, k].astype(np.int8)[data], at - at[0]) for k in range(KINDS.shape[1])]
            n_lines, n_dup = repeated_lines(text)
            found = (np.diff(offsets), signs[0], signs[1], n_dup, repeated_words(codes, offsets), signs[2], n_lines, signs[3], signs[4])
            yield pa.record_batch([column(rows, "doc_id").cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in found)], names=["doc_id", *STATISTICS])

    return documents_of(docs).mapInArrow(counted, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


def base_failed() -> Column:
    """Whether a document breaks a base rule by itself."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def features(rows: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits: mean length of words, and shares of the rules' counts, one column each.

    Repeated words are left to the base rule; of repeated lines the square counts, as good texts repeat single lines.
    """
    c = {k: np.asarray(v, float) for k, v in rows.items()}
    return np.column_stack(
        [
            (c["word_chars"] + 5 * CALM_WORDS) / (c["n_words"] + CALM_WORDS),
            c["n_symbols"] / (c["n_words"] + CALM_WORDS),
            c["n_marks"] / (c["n_words"] + CALM_WORDS),
            c["n_capitals"] / (c["n_chars"] + CALM_CHARS),
            (c["n_dup_lines"] / (c["n_lines"] + CALM_LINES)) ** 2,
        ]
    )


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of a search that fails in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, spread: np.ndarray, seed: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random tree over rows x as a heap: feature (-1: leaf), split value and, at leaves, path length of every node.

    A node is split at random in a random feature, between its smallest and largest value or up to `spread` beyond them,
    so that values no row has, as in a feature that is always 0, leave the tree early, by an empty leaf.
    """
    size = (1 << (depth + 1)) - 1
    feature, value, path = np.full(size, -1, np.int16), np.zeros(size), np.zeros(size)
    r, nodes = np.random.default_rng(seed), [(0, 0, np.arange(len(x)))]
    while nodes:
        node, level, rows = nodes.pop()
        if level == depth or len(rows) <= 1:
            path[node] = level + float(mean_path(len(rows)))
            continue
        f = int(r.integers(x.shape[1]))
        low, high = x[rows, f].min() - spread[f], x[rows, f].max() + spread[f]
        if high <= low:
            path[node] = level + float(mean_path(len(rows)))
            continue
        feature[node], value[node] = f, r.uniform(low, high)
        left = x[rows, f] < value[node]
        nodes += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return feature, value, path


class Forest(NamedTuple):
    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, from 0 to 1: 2 to the power of minus its mean path over the usual one."""
        total = np.zeros(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[np.arange(len(x)), f] >= value[node]))
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.path)) / max(1.0, float(mean_path(self.rows))))


def fit(statistics: DataFrame, labels: DataFrame) -> Forest:
    """A forest over documents labelled good, which say what is usual; base failures take no part.

    About `SAMPLE_ROWS` labelled rows, chosen by a hash of the id, are used; that bound lets them be broadcast. Every
    tree is grown by itself on some `ROWS_PER_TREE` of them; few rows take part in several trees. At most TREES trees
    of a fixed size reach the driver. `labels` has `doc_id` and `label` (1 good, 0 bad, others ignored). No good
    document: no trees, and every score is 1.
    """
    known = cut(labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("forest"), "doc_id"), F.lit(1 << 20))
    rows = statistics.where(~base_failed()).join(F.broadcast(known.where(draw < F.lit(int(share * (1 << 20))))), "doc_id")
    rows = cut(rows.dropDuplicates(["doc_id", *STATISTICS]))
    n = rows.where("label = 1").count()
    names = ", ".join(STATISTICS)
    if not n:
        return Forest(np.zeros((0, 1), np.int16), np.zeros((0, 1)), np.zeros((0, 1)), 1)
    spans = _spans(rows)
    copies = min(TREES, -(-TREES * ROWS_PER_TREE // n))
    first = F.pmod(F.xxhash64(F.lit("tree"), "doc_id"), F.lit(TREES))
    step = F.lit(2) * F.pmod(F.xxhash64(F.lit("step"), "doc_id"), F.lit(TREES // 2)) + 1
    tree = F.pmod(first + F.col("k") * step, F.lit(TREES)).cast("int").alias("tree")
    dealt = rows.where("label = 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(tree, "doc_id", *STATISTICS)

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", *STATISTICS], kind="stable").iloc[: 4 * ROWS_PER_TREE]
        feature, value, path = grow(features({s: rows[s].to_numpy() for s in STATISTICS}), BEYOND * spans, int(rows["tree"].iloc[0]))
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "n": [len(rows)], "feature": [feature.astype("<i2").tobytes()], "value": [value.astype("<f8").tobytes()], "path": [path.astype("<f8").tobytes()]})

    trees = dealt.groupBy("tree").applyInPandas(grown, "tree int, n int, feature binary, value binary, path binary").orderBy("tree").collect()
    read = lambda name, kind: np.stack([np.frombuffer(t[name], kind) for t in trees])
    return Forest(read("feature", "<i2"), read("value", "<f8"), read("path", "<f8"), max(2, sum(t["n"] for t in trees) // len(trees)))


def _spans(rows: DataFrame) -> np.ndarray:
    """The whole range of each feature over labelled rows, good and bad."""

    def ranges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = features({s: rows[s].to_numpy() for s in STATISTICS})
                yield pd.DataFrame({"feature": np.arange(x.shape[1]), "low": x.min(axis=0), "high": x.max(axis=0)})

    found = rows.select(*STATISTICS).mapInPandas(ranges, "feature int, low double, high double")
    sums = found.groupBy("feature").agg((F.max("high") - F.min("low")).alias("span")).orderBy("feature").collect()
    return np.array([r["span"] for r in sums])


def score(statistics: DataFrame, forest: Forest) -> DataFrame:
    """`statistics` with `anomaly`, from 0 (usual) to 1."""

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = features({s: column(rows, s).to_numpy() for s in STATISTICS})
            yield rows.append_column("anomaly", pa.array(forest.scores(x) if len(forest.path) else np.ones(len(x))))

    fields = ", ".join(f"{n} {t}" for n, t in statistics.dtypes)
    return statistics.mapInArrow(scored, f"{fields}, anomaly double")


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The anomaly from which documents go: of `BINS` limits, the one that best tells labelled good from bad rows.

    Best is the largest share of bad rows above it less the share of good rows above it; of equal ones the middle. All
    labelled rows count that pass the base rules, as BINS numbers for each label. Without rows of both labels nothing goes.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    bins = scored.where(~base_failed()).select("doc_id", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).join(known, "doc_id")
    counts = np.zeros((2, BINS + 2))
    for r in bins.groupBy("label", "bin").count().collect():
        counts[r["label"], r["bin"]] = r["count"]
    if not counts.sum(axis=1).all():
        return 2.0
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] / counts.sum(axis=1, keepdims=True)
    best = np.flatnonzero(above[0] - above[1] >= (above[0] - above[1]).max() - 1e-12)
    return float(best[len(best) // 2]) / BINS


def judge_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, the STATISTICS, `anomaly`, `base_failed` and `kept` of every document.

    A document is kept if it passes the base rules and its anomaly lies below the limit that `threshold` learns from
    `labels` (`doc_id`, `label`). Texts are read once, whole; the statistics are a written table from then on. A null
    or empty text has no words and fails; rows without a doc_id are left out, rows that repeat one are judged each by
    their own text; an empty table gives no rows; other columns are not read. Reruns agree.
    """
    statistics = cut(rule_statistics(docs))
    scored = score(statistics, fit(statistics, labels))
    limit = threshold(scored, labels)
    return scored.select("*", base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") < F.lit(limit))).alias("kept"))
