"""Stored postings: which chunk holds which word how often, clustered by word, as plain tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import let, no_strings
from tessera.functions.text import tokens
from tessera.operators.unnest import unnest
from tessera.operators.upsert import without_sources
from tessera.sources.cut import cut, shuffles_removed, temporary_tables

FILTER_COLUMNS = ("domain", "source_id", "version")
# The word that every chunk holds once, so that its statistics are those of the corpus; no token is empty.
CORPUS = ""
# A word's postings are dealt to one part for so many chunks; tables have so many buckets of words.
PART_ROWS, BUCKETS = 100_000, 64
# A step that shuffles postings takes them in rounds of about so many, in at most so many rounds, each of which reads the blocks anew.
ROUND_POSTINGS, ROUNDS = 1_000_000, 8
# So many neighbouring chunks at most share a block, that is one row per word.
BLOCK_CHUNKS = 2048
BUCKET = "word_bucket"
BLOCK = "term string, base long, variant int, at array<int>, tf array<long>, tokens long"
BLOCKS = f"term string, part int, base long, variant int, at array<int>, tf array<long>, {BUCKET} int"
DOCS = "doc long, variant int, chunk_id string, domain string, source_id string, version string, length int, base long"


@dataclass(frozen=True)
class Postings:
    """The index of a chunk table.

    blocks: term, part, base, variant, at, tf: a word's occurrences in the chunks of numbers base + at[i]
    docs:   doc, variant, chunk_id, domain, source_id, version, length, base (of the blocks that hold it)
    stats:  term, df (chunks with it), tokens (their summed length), parts

    A chunk id has the number `doc`; chunks that share it but differ in another of these columns are its variants. The
    blocks, by far the largest table, hold these numbers in place of texts, and a word once for many chunks; lengths stand
    once per chunk, in `docs`. A word held
    by many chunks is split into `parts`, as its `df` asks; the parts are join keys, so no word, however common, is one
    task. The empty word's blocks have all chunks.
    """

    blocks: DataFrame
    docs: DataFrame
    stats: DataFrame

    @property
    def occurrences(self) -> DataFrame:
        """A row per word and chunk: term, part, doc, variant, tf."""
        stored = [c for c in (BUCKET, "word") if c in self.blocks.columns]
        rows = self.blocks.select("term", "part", "base", "variant", *stored, F.explode(F.arrays_zip("at", "tf")).alias("p"))
        return rows.select("term", "part", (F.col("base") + F.col("p.at")).alias("doc"), "variant", F.col("p.tf").alias("tf"), *stored)

    @property
    def lists(self) -> DataFrame:
        """The occurrences with `length` (tokens of the chunk), for which they are joined with the chunks."""
        return self.occurrences.join(self.docs.select("doc", "variant", "length"), ["doc", "variant"])

    @property
    def rows(self) -> DataFrame:
        """The lists with the chunks' columns: term, part, chunk_id, domain, source_id, version, tf, length."""
        stored = [BUCKET] if BUCKET in self.blocks.columns else []
        named = self.occurrences.join(self.docs.drop("base"), ["doc", "variant"])
        return named.select("term", "part", "chunk_id", *FILTER_COLUMNS, "tf", "length", *stored)

    def write(self, path: str, buckets: int = BUCKETS) -> "Postings":
        """Keeps the index in a new folder, in buckets of words (at most some thousands), sorted by word; returns it as read back."""
        keyed, spark = self.blocks.withColumn(BUCKET, _bucket(F.col("term"), buckets)), self.blocks.sparkSession
        rounds = rounds_for(self.stats.agg(F.sum("df")).first()[0] or 0)
        with shuffles_removed(spark):
            for turn in range(rounds):
                some = keyed.where(F.col(BUCKET) % rounds == turn).repartition(BUCKET, "term", "part")
                some = some.sortWithinPartitions(BUCKET, "term", "base", "variant").write.mode("append" if turn else "errorifexists")
                some.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{path}/blocks")
        self.docs.write.parquet(f"{path}/docs")
        self.stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")
        return Postings.read(self.blocks.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Postings":
        blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        return Postings(blocks, spark.read.schema(DOCS).parquet(f"{path}/docs"), spark.read.parquet(f"{path}/stats"))

    def of(self, terms: DataFrame) -> "Postings":
        """The part of the index that can hold the given words (column `term`): of a stored one, their buckets only.

        A bucket's number is all that reaches the driver, at most as many as the table has.
        """
        stats = cut(self.stats.join(terms.select("term").distinct().union(_corpus(terms.sparkSession)), "term", "left_semi"))
        blocks = self.blocks
        if BUCKET in blocks.columns:
            of = _bucket(F.col("term"), F.col("buckets"))
            wanted = [r[0] for r in stats.where(F.col("term") != CORPUS).select(of).distinct().collect()]
            blocks = blocks.where(F.col(BUCKET).isin(wanted))
        return Postings(blocks, self.docs, stats)

    def only(self, words: DataFrame) -> "Postings":
        """The blocks of the given words alone (columns term, part and `word`, their number, which is kept)."""
        return Postings(self.blocks.join(words, ["term", "part"]), self.docs, self.stats)

    def turn(self, turn: int, rounds: int) -> "Postings":
        """The blocks and chunks of one round of several; a chunk with all its words and variants is in one of them."""
        mine = F.pmod(F.xxhash64("base"), F.lit(rounds)) == turn
        return Postings(self.blocks.where(mine), self.docs.where(mine), self.stats)

    def refreshed(self, chunks: DataFrame, sources: DataFrame) -> "Postings":
        """The index after an ingest: rows of the changed `sources` (column source_id) go, those of their new `chunks` come.

        Only the new chunks are tokenised; write the result to a folder of its own. Numbers of words change by what goes
        and comes, parts are counted anew. The chunks that go are found in a block by their place, so no posting is joined with them.
        """
        with temporary_tables(self.docs.sparkSession) as keep:
            names = self.docs.columns
            gone = cut(self.docs.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("doc", "variant", "base", "length"))
            kept = without_sources(self.docs, sources).select(*names)
            last = self.docs.agg(F.coalesce(F.max("doc"), F.lit(-1)).alias("last")).first()["last"]
            docs, new = _numbered(chunks, last + 1)
            spots = gone.select("base", "variant", (F.col("doc") - F.col("base")).cast("int").alias("spot"), "length")
            places = spots.groupBy("base", "variant").agg(F.max("spot").alias("most"))
            places = places.select("base", "variant", F.explode(F.sequence(F.lit(0), "most")).alias("spot"))
            marked = places.join(spots.distinct(), ["base", "variant", "spot"], "left")
            marked = marked.groupBy("base", "variant").agg(F.array_sort(F.collect_list(F.struct("spot", "length"))).alias("s"))
            # The length of a chunk that goes, null for one that stays.
            marks = keep(marked.select("base", "variant", F.col("s.length").alias("lost")))
            new, docs = keep(new), keep(kept.unionByName(docs.select(*names)))
        # Only the new blocks are kept beside the stored ones; both are read again when the result is written.
        lengths = self.blocks.join(marks, ["base", "variant"]).select("term", F.filter(F.transform("at", lambda a: F.get("lost", a)), lambda n: n.isNotNull()).alias("n"))
        lost = F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a - n)
        less = lengths.where(F.size("n") > 0).select("term", (-F.size("n")).cast("long").alias("df"), lost.alias("tokens"))
        more = new.select("term", F.size("at").cast("long").alias("df"), "tokens")
        p = F.arrays_zip("at", "tf")
        stays = F.when(F.col("lost").isNull(), p).otherwise(F.filter(p, lambda p: F.get("lost", p["at"]).isNull()))
        old = self.blocks.join(marks, ["base", "variant"], "left").select("term", "base", "variant", stays.alias("p")).where(F.size("p") > 0)
        old = old.select("term", "base", "variant", *[F.col(f"p.{c}").alias(c) for c in ("at", "tf")])
        return _dealt(old.unionByName(new.drop("tokens")), docs, self.stats.select("term", "df", "tokens").unionByName(less).unionByName(more))


def rounds_for(postings: int) -> int:
    """Rounds in which so many postings are shuffled: files of a round are gone when the next one makes its own."""
    return max(1, min(ROUNDS, -(-int(postings) // ROUND_POSTINGS)))


def _corpus(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(CORPUS).alias("term"))


def _bucket(term: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """Chunk id, filter columns, all tokens of text, title and tags, and their number."""
    said = F.concat_ws(
        " ",
        F.coalesce(F.col("text"), F.lit("")),
        F.coalesce(F.col("title"), F.lit("")),
        F.array_join(F.coalesce(F.col("entity_tags"), no_strings()), " "),
    )
    words = chunks.select("chunk_id", *FILTER_COLUMNS, tokens(said).alias("words"))
    return words.withColumn("length", F.size("words"))


def _count_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered chunks with their words as blocks; the empty word's block also has the chunks' own columns."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_CHUNKS):
            chunks = batch.slice(start, BLOCK_CHUNKS)
            n, doc, length = chunks.num_rows, chunks.column("doc").to_numpy(), chunks.column("length").to_numpy()
            base, spots = int(doc[0]), (doc - doc[0]).astype(np.int32)
            words = chunks.column("words").flatten().dictionary_encode()
            codes, row = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), length)
            keys, times = np.unique(codes * n + row, return_counts=True)
            code, row = np.divmod(keys, n)
            # The empty word comes first, with every chunk once.
            row, times = np.concatenate([np.arange(n), row]), np.concatenate([np.ones(n, np.int64), times])
            ends = n + np.cumsum(np.bincount(code, minlength=len(words.dictionary)))
            offsets = pa.array(np.concatenate([[0, n], ends]).astype(np.int32))
            terms = pa.concat_arrays([pa.array([CORPUS]), words.dictionary.cast(pa.string())])
            listed = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            out = [terms, pa.array(np.full(len(terms), base), pa.int64()), pa.array(np.zeros(len(terms)), pa.int32())]
            tokens = np.diff(np.concatenate([[0], np.cumsum(length[row], dtype=np.int64)])[offsets.to_numpy()])
            out += [listed(spots[row], pa.int32()), listed(times, pa.int64()), pa.array(tokens, pa.int64())]
            first = pa.array(np.concatenate([[0, n], np.full(len(terms) - 1, n)]).astype(np.int32))
            none = pa.array(np.concatenate([[False], np.ones(len(terms) - 1, bool)]))
            for name, kind in (("length", pa.int32()), *((c, pa.string()) for c in ("chunk_id", *FILTER_COLUMNS))):
                out.append(pa.ListArray.from_arrays(first, chunks.column(name).cast(kind), mask=none))
            yield pa.RecordBatch.from_arrays(out, ["term", "base", "variant", "at", "tf", "tokens", "length", "chunk_id", *FILTER_COLUMNS])


def _numbered(chunks: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """The chunks with their numbers from `first` on, and the blocks of their words, the empty word's included.

    Chunks are numbered and counted where they are; only those that share their id are brought together.
    """
    own = ["chunk_id", *FILTER_COLUMNS]
    several = cut(chunks.groupBy(F.col("chunk_id").alias("of_id")).agg(F.count("*").alias("times")).where("times > 1").select("of_id"))
    repeats = not several.isEmpty()
    same = chunks["chunk_id"].eqNullSafe(several["of_id"])
    words = chunk_words(chunks.join(several, same, "left_anti") if repeats else chunks)
    words = words.select((F.monotonically_increasing_id() + first).alias("doc"), "length", "words", *own)
    found = cut(words.mapInArrow(_count_blocks, f"{BLOCK}, length array<int>, {', '.join(f'{c} array<string>' for c in own)}"))
    docs = found.where(F.col("term") == CORPUS).select("base", "variant", F.explode(F.arrays_zip("at", "length", *own)).alias("p"))
    docs = docs.select((F.col("base") + F.col("p.at")).alias("doc"), "variant", *[F.col(f"p.{c}").alias(c) for c in (*own, "length")], "base")
    blocks = found.select("term", "base", "variant", "at", "tf", "tokens")
    if not repeats:
        return docs, blocks
    last = docs.agg(F.coalesce(F.max("doc"), F.lit(first - 1)).alias("last")).first()["last"]
    more, counted = _numbered_several(chunks.join(several, same, "left_semi"), last + 1)
    single = [F.array(F.lit(0)).alias("at"), F.array("tf").alias("tf"), F.col("length").cast("long").alias("tokens")]
    counted = cut(counted).select("term", F.col("doc").alias("base"), "variant", *single)
    return docs.unionByName(more.withColumn("base", F.col("doc"))), blocks.unionByName(counted)


def _numbered_several(chunks: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """The same for chunks that share their ids, with a row for each word and chunk, the empty word once.

    The words of a chunk are shuffled once, as they stand, to bring chunks of one id together; counting is row-local.
    Chunks equal in all columns but their words are one, with the words of all.
    """
    keep = [*FILTER_COLUMNS, "length"]
    words = chunk_words(chunks).withColumn("words", F.array_sort("words")).repartition("chunk_id")
    equal = words.groupBy("chunk_id", *keep, "words").agg(F.count("*").alias("times"))
    one = equal.groupBy("chunk_id", *keep).agg(F.collect_list(F.struct("words", "times")).alias("texts"))
    ids = one.groupBy("chunk_id").agg(F.collect_list(F.struct(*keep, "texts")).alias("variants"))
    ids = cut(ids.select((F.monotonically_increasing_id() + first).alias("doc"), "chunk_id", "variants"))
    rows = ids.select("doc", "chunk_id", F.posexplode("variants").alias("variant", "v"))
    docs = rows.select("doc", "variant", "chunk_id", *[F.col("v")[c].alias(c) for c in keep])
    place = ["doc", "variant", "length"]
    texts = rows.select("doc", "variant", F.col("v.length").alias("length"), F.size("v.texts").alias("n"), F.explode("v.texts").alias("t"))
    found = unnest(texts, [*place, "n", F.col("t.times").alias("times")], _counts(F.col("t.words")), "found")
    found = found.select(*place, "n", F.col("found.term").alias("term"), (F.col("found.tf") * F.col("times")).alias("tf"))
    mixed = found.where("n > 1").groupBy(*place, "term").agg(F.sum("tf").alias("tf"))
    corpus = docs.select("doc", "variant", "length", F.lit(CORPUS).alias("term"), F.lit(1).cast("long").alias("tf"))
    return docs, found.where("n = 1").drop("n").unionByName(mixed).unionByName(corpus)


def _counts(words: Column) -> Column:
    """Each word of a sorted array once, with its number."""
    n = F.size(words)
    heads = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: (e["i"] == 0) | (F.get(words, e["i"] - 1) != e["w"])
    )
    ends = lambda h, j: F.coalesce(F.get(h, j + 1)["i"], n)
    return let(heads, lambda h: F.transform(h, lambda e, j: F.struct(e["w"].alias("term"), (ends(h, j) - e["i"]).cast("long").alias("tf"))))


def build_postings(chunks: DataFrame, only: DataFrame | None = None) -> Postings:
    """The index of a chunk table, counted once; with `only` (column `term`) that of a query batch's words."""
    with temporary_tables(chunks.sparkSession) as keep:
        docs, blocks = _numbered(chunks)
        if only is not None:
            blocks = blocks.join(only.select("term").distinct().union(_corpus(chunks.sparkSession)), "term", "left_semi")
        docs, blocks = keep(docs), keep(blocks)
    return _dealt(blocks, docs)


def _dealt(blocks: DataFrame, docs: DataFrame, counted: DataFrame | None = None) -> Postings:
    """The index of these blocks: those of a word of several parts are cut into as many pieces, one for each part.

    `counted` has rows `term, df, tokens` that add up to each word's numbers, where the blocks do not.
    """
    counted = blocks.select("term", F.size("at").alias("df"), "tokens") if counted is None else counted
    stats = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).where("df > 0")
    stats = cut(stats.withColumn("parts", F.ceil(F.col("df") / PART_ROWS).cast("int")))
    hot = stats.where("parts > 1").select("term", "parts")
    n = F.size("at")
    rows = blocks.join(hot, "term", "left").withColumn("pieces", F.when(F.col("parts").isNull(), 1).otherwise(F.least("parts", n)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    edge = lambda j: F.floor(n.cast("long") * j / F.col("pieces")).cast("int")
    begin, end = edge(F.col("piece")), edge(F.col("piece") + 1)
    part = F.coalesce(F.pmod(F.pmod(F.xxhash64("base"), "parts") + F.col("piece"), "parts"), F.lit(0)).cast("int").alias("part")
    cut_out = lambda c: F.when(F.col("parts").isNull(), F.col(c)).otherwise(F.slice(c, begin + 1, end - begin)).alias(c)
    rows = rows.select("term", part, "base", "variant", *[cut_out(c) for c in ("at", "tf")])
    return Postings(rows, docs, stats)
