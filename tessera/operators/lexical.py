"""Nearest chunks by words: BM25 over stored postings, or substring scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.arrays import strings
from tessera.functions.text import clean, tokens
from tessera.operators.blockscan import HIT_COLUMNS, PhraseScorer, best_chunks
from tessera.operators.postings import CORPUS, FILTER_COLUMNS, Postings, build_postings, rounds_for
from tessera.operators.topk import top_k
from tessera.operators.unnest import unnest
from tessera.sources.cut import cut

# A task of BM25 makes about so many rows of a query and a chunk that share a word.
PAIRS = 1_000_000


def index_for(chunks: DataFrame, texts: DataFrame) -> Postings:
    """Index of the words of the given `query_text` rows, where none is stored."""
    terms = unnest(texts, [], F.array_distinct(tokens(F.col("query_text"))), "term")
    return build_postings(chunks, terms)


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per query and distinct token."""
    keep = ["query_id", "k", "domains", "source_ids", "versions"]
    return unnest(queries, keep, F.array_distinct(tokens(F.col("query_text"))), "term")


def passes_filters():
    """Join condition: the chunk meets the query's domain, source and version lists."""

    def met(values: str, column: str):
        return (F.size(values) == 0) | F.coalesce(F.array_contains(values, F.col(column)), F.lit(False))

    return met("domains", "domain") & met("source_ids", "source_id") & met("versions", "version")


def bm25_hits(
    chunks: DataFrame,
    queries: DataFrame,
    cfg: SearchConfig = SearchConfig(),
    index: Postings | None = None,
) -> DataFrame:
    """BM25 top-k per query with rank.

    An equi-join of query words with their postings, brought together by chunk, so that scores are summed where they are
    found. With a stored `index` no chunk is read or tokenised; without
    one, the words of this batch are indexed first. A query word goes to every part of its postings, and there are as
    many parts as its number of chunks asks, so a word found in most chunks is split over tasks. Statistics are those of
    the whole table, so a filter never changes a score.
    """
    wanted = query_terms(queries)
    if index is None:
        index = build_postings(chunks, wanted)
    index = index.of(wanted)
    asked = cut(weighted_terms(wanted, index.stats).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    k1, b = cfg.bm25_k1, cfg.bm25_b
    tf, length = F.col("tf"), F.col("length")
    share = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))
    # Lists are dealt by chunk before they meet the queries: what is shuffled is a row per posting, not one per posting
    # and query, with numbers in place of words. There are as many tasks as the rows that come of it ask, so what a task sums fits its memory.
    df = index.stats.select("term", (F.col("df") / F.col("parts")).alias("df"))
    counted = asked.groupBy("term", "part").agg(F.count("*").alias("times")).join(df, "term")
    made, listed = counted.agg(F.sum(F.col("times") * F.col("df")), F.sum("df")).first()
    words = cut(asked.select("term", "part").distinct().withColumn("word", F.monotonically_increasing_id()))
    asked = asked.join(words, ["term", "part"])
    order, rounds = [F.desc("score"), F.col("chunk_id")], rounds_for(listed or 0)

    def best(some: Postings) -> DataFrame:
        lists = some.occurrences.select("word", "doc", F.col("variant").alias("_variant"), "tf")
        lists = lists.repartition(max(2, int((made or 0) / rounds // PAIRS) + 1), "doc")
        here = lists.join(some.docs.drop("base"), "doc")
        here = here.where((F.col("_variant") - F.col("variant")) == 0)
        scored = (
            # Few and written, the query words are sent to the postings while they are small; their sizes are known.
            here.join(asked, "word")
            .filter(passes_filters())
            .groupBy("doc", "query_id", "chunk_id", "source_id")
            .agg(F.round(F.sum(share), cfg.score_digits).alias("score"), F.first("k").alias("k"))
            .filter(F.col("score") > 0)
        )
        return top_k(scored, ["query_id"], order, k="k")

    index = index.only(words)
    if rounds == 1:
        return best(index).select(*HIT_COLUMNS)
    # Chunks are taken in rounds, of each of which only its best are kept, so few postings are in shuffle files at once.
    found = [cut(best(index.turn(n, rounds)).select("query_id", "chunk_id", "source_id", "score", "k")) for n in range(rounds)]
    return top_k(reduce(DataFrame.unionByName, found), ["query_id"], order, k="k").select(*HIT_COLUMNS)


def weighted_terms(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the inverse document frequency of each word, its parts, and the mean chunk length."""
    totals = F.struct(F.col("df").cast("double").alias("n"), (F.col("tokens") / F.col("df")).alias("mean"))
    corpus = stats.filter(F.col("term") == CORPUS).select(totals.alias("c")).scalar()
    n, df = corpus["n"], F.col("df")
    return wanted.join(stats.select("term", "df", "parts"), "term").select(
        *wanted.columns, "parts", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"), corpus["mean"].alias("mean")
    )


def scan_hits(
    chunks: DataFrame, queries: DataFrame, cfg: SearchConfig = SearchConfig()
) -> DataFrame:
    """Substring top-k per query with rank; rows that score nothing are no hits."""
    narrow = chunks.select(
        "chunk_id",
        *FILTER_COLUMNS,
        F.lower(clean(F.col("text"))).alias("text_lc"),
        F.transform(strings(F.col("entity_tags")), F.lower).alias("tags_lc"),
    )
    text = clean(F.col("query_text"))
    asked = queries.select(
        "query_id",
        "k",
        "domains",
        "source_ids",
        "versions",
        F.lower(text).alias("query_lc"),
        tokens(text).alias("tokens"),
    )
    return best_chunks(narrow, asked, PhraseScorer, cfg)


def lexical_hits(
    chunks: DataFrame,
    queries: DataFrame,
    cfg: SearchConfig = SearchConfig(),
    index: Postings | None = None,
) -> DataFrame:
    """Hits of the configured text mode, with the mode that produced them."""
    if cfg.text_mode == "scan":
        return scan_hits(chunks, queries, cfg).withColumn("mode", F.lit("scan"))
    scored = bm25_hits(chunks, queries, cfg, index).withColumn("mode", F.lit("bm25"))
    if cfg.text_mode == "bm25":
        return scored
    scored = cut(scored)
    silent = cut(queries.join(scored.select("query_id").distinct(), "query_id", "left_anti"))
    if silent.isEmpty():
        return scored
    return scored.unionByName(scan_hits(chunks, silent, cfg).withColumn("mode", F.lit("scan")))
