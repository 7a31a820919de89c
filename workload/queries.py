"""Registered queries: one per operator or pipeline, each over whole driver tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ChunkRules
from tessera.functions import text as T
from tessera.functions.jsonwalk import canonical_json_hash, json_lines
from tessera.functions.text import clean
from tessera.functions.vectors import cosine, hash_embedding
from tessera.operators.chunking import (
    chunk_documents,
    custom_chunks,
    json_documents,
    qna_blocks,
    qna_chunks,
    record_text,
)
from tessera.operators.fusion import fuse_hits, tag_overlap
from tessera.operators.health import (
    compare_counts,
    document_profile,
    domain_distribution,
    source_counts,
    source_status,
    table_health,
)
from tessera.operators.lexical import bm25_hits, lexical_hits, scan_hits
from tessera.operators.models import dimension_profile, model_answer, model_embedding
from tessera.operators.tagging import (
    entities,
    key_field_map,
    key_fields,
    merge_model_tags,
    rule_domain,
    tag_prompts,
    with_rule_tags,
)
from tessera.operators.topk import latest_per_key, top_k
from tessera.operators.unnest import unnest
from tessera.operators.upsert import upsert_counts, upsert_rows, without_sources
from tessera.operators.vector_search import assign_cells, cell_vector_hits, exact_vector_hits, mean_cells, train_cells
from tessera.plans.build import build_chunks, complete_documents, new_chunks_only
from tessera.plans.context import answer_prompts, build_context
from tessera.sources.cut import cut, shared_folder
from tessera.plans.ingest import incremental_ingest, ingest_qna, ingest_summary, text_sources
from tessera.plans.planner import active_filters, plan_queries
from tessera.plans.relax import search_with_relaxation
from tessera.plans.search import (
    candidate_sizes,
    complete_queries,
    filter_lists,
    hybrid_search,
    metadata_filter,
    prepare_queries,
    text_hits,
    vector_hits,
)
from tessera.sources.files import json_files, json_records
from tessera.sources.payloads import json_payloads, qna_pairs, text_documents
from tessera.sources.queries import query_file, query_json, query_texts
from tessera.sources.sinks import evidence_report, write_previews
from tessera.sources.spread import spread
from tessera.sources.store import chunk_table as stored_chunk_table
from tessera.sources.store import manifest_table
from workload.common import (
    INGEST,
    RULES,
    SEARCH,
    chunk_table,
    documents,
    labelled_documents,
    plain_queries,
    planned_queries,
    postings,
    questions,
    strict_queries,
    table,
)


def joined(values) -> F.Column:
    return F.array_join(values, "|")


# --- text and chunks -------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", T.clean(F.col("text")).alias("clean_text"), T.preview(F.col("text"), 40).alias("preview"))


def tokenize_counts(spark, sf):
    rows = unnest(spread(table(spark, sf, "documents")), [], T.tokens(F.col("text")), "token")
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def line_chunks(spark, sf):
    return chunk_documents(documents(spark, sf)).select("source_id", "order", "section", "text")


def chunk_ids(spark, sf):
    return chunk_documents(documents(spark, sf)).select("chunk_id", "source_id", "order")


def doc_profile(spark, sf):
    return document_profile(documents(spark, sf), ChunkRules().text_lines)


def qna_text(spark, sf):
    return qna_blocks(qna_pairs(table(spark, sf, "conversations"))).select("source_id", "pos", "block")


def qna_chunk_rows(spark, sf):
    # Line breaks become separators here, because the table has no separator of its own.
    turns = table(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit("---")))
    blocks = qna_blocks(qna_pairs(turns))
    return qna_chunks(blocks).select("source_id", "order", "section", "text", "chunk_id")


def json_flatten_props(spark, sf):
    events = spread(table(spark, sf, "events"))
    return unnest(events, ["event_id"], json_lines(F.col("props")), "line", "pos")


def _order_json(spark, sf):
    """Nested JSON per order line: lists in objects, numbers, text, null and booleans."""
    items = spread(table(spark, sf, "lineitem"))
    body = F.struct(
        F.col("l_orderkey").alias("order"),
        F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("keys"),
        F.array(F.col("l_quantity"), F.col("l_discount")).alias("numbers"),
        F.array(
            F.struct(F.col("l_returnflag").alias("flag"), (F.col("l_tax") > 0.04).alias("taxed")),
            F.struct(F.col("l_linestatus").alias("flag"), F.lit(None).cast("boolean").alias("taxed")),
        ).alias("state"),
        F.lit(" ").alias("blank"),
    )
    return items.select(
        F.concat_ws(
            "-", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate")
        ).alias("source_id"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )


def json_flatten_nested(spark, sf):
    return unnest(_order_json(spark, sf), ["source_id"], json_lines(F.col("json")), "line", "pos")


def json_chunks(spark, sf):
    docs = json_documents(_order_json(spark, sf))
    rules = ChunkRules(json_lines=4)
    return chunk_documents(docs, rules).select("source_id", "order", "section", "text", "chunk_id")


def record_description(spark, sf):
    """Nested hall records, made of the part table, as labelled text."""
    parts = table(spark, sf, "part")
    rooms = F.array(
        F.struct(
            F.col("p_brand").alias("name"),
            (F.col("p_size") > 25).alias("ensuite"),
            F.lit("single").alias("occupancy"),
            F.col("p_size").alias("tenancy_weeks"),
            F.array(
                F.struct(
                    F.col("p_retailprice").alias("per_week_gbp"), F.col("p_size").alias("total_contract_gbp")
                )
            ).alias("prices"),
        )
    )
    halls = parts.select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        F.lit(None).cast("string").alias("address"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("short_description"),
        F.lit("self_catered").alias("catering_type"),
        F.split("p_name", " ").alias("services"),
        F.when(F.col("p_size") > 20, F.split("p_type", " ")).alias("facilities"),
        rooms.alias("room_types"),
    )
    return halls.select("p_partkey", record_text().alias("text"))


# --- tags and vectors ------------------------------------------------------------------------


def rule_domains(spark, sf):
    chunks = chunk_documents(documents(spark, sf))
    found = rule_domain(F.col("source_id"), F.col("text"), RULES)
    return chunks.select("chunk_id", F.coalesce(found, F.lit("unknown")).alias("domain"))


def domain_counts(spark, sf):
    return domain_distribution(rule_domains(spark, sf))


def entity_tags(spark, sf):
    chunks = chunk_documents(documents(spark, sf))
    return chunks.select("chunk_id", joined(entities(F.col("text"))).alias("tags"))


def key_field_flags(spark, sf):
    """Key fields of the flattened order lines and of text mentioning prices."""
    rows = _order_json(spark, sf)
    # Renamed paths, so that the lines hold the words the rules look for.
    renamed = rows.withColumn(
        "json",
        F.replace(F.replace(F.col("json"), F.lit('"numbers"'), F.lit('"per_week_gbp"')), F.lit('"part"'), F.lit('"name"')),
    )
    docs = json_documents(renamed)
    return docs.select("source_id", key_fields(F.col("text")).alias("k")).select(
        "source_id",
        "k.contains_price",
        "k.contains_entry_requirements",
        "k.contains_location",
        "k.contains_question_answer",
        joined("k.sample_price_lines").alias("sample_price_lines"),
        "k.sample_name",
    )


def hash_embed(spark, sf):
    rows = unnest(documents(spark, sf), ["source_id"], hash_embedding(F.col("text")), "value", "dim")
    return rows.withColumn("value", F.round("value", 6))


def embedding_dims(spark, sf):
    return dimension_profile(table(spark, sf, "embeddings"), 64)


def vector_pairs(spark, sf):
    """Cosine of each stored vector and the hash vector of the document with the same number."""
    vectors = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("similarity")
    )


def model_tags(spark, sf):
    """Model answers of mixed quality, made of the event rows, laid over rule tags."""
    events = spread(table(spark, sf, "events"))
    body = F.concat(
        F.lit('{"domain": "'),
        F.when(F.col("value") < 5, "Sports ").when(F.col("value") < 9, "music").otherwise(""),
        F.lit('", "entity_tags": ["'),
        F.col("event_type"),
        F.lit('", "'),
        F.upper("event_type"),
        F.lit('", 7, null], "key_fields": '),
        F.col("props"),
        F.lit(', "confidence": 0.'),
        F.get_json_object("props", "$.k"),
        F.lit("}"),
    )
    answer = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", F.concat(F.lit("Sure: "), body, F.lit(" Done.")))
        .when(F.col("event_type") == "signup", F.lit("no idea"))
        .otherwise(body)
    )
    chunks = events.select(
        "event_id",
        F.col("event_type").alias("source_id"),
        F.concat(F.lit("User From "), F.col("user_id").cast("string"), F.lit(" with")).alias("text"),
        answer.alias("answer"),
    )
    tagged = merge_model_tags(with_rule_tags(chunks, RULES), "answer")
    return tagged.select(
        "event_id",
        "domain",
        joined("entity_tags").alias("entity_tags"),
        F.element_at("extra", "k").alias("extra_k"),
        F.element_at(key_field_map(F.col("key_fields"), F.col("extra")), "contains_price").alias("flag"),
        F.round("confidence", 6).alias("confidence"),
    )


def chunk_records(spark, sf):
    """Finished chunk records."""
    rows = build_chunks(documents(spark, sf), INGEST)
    return rows.select(
        "chunk_id",
        "source_id",
        "source_type",
        "text",
        "domain",
        joined("entity_tags").alias("tags"),
        "section",
        "order",
        F.col("metadata.confidence").alias("confidence"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
        F.size("embedding").alias("dim"),
        "version",
    )


# --- search ----------------------------------------------------------------------------------


def _vectors(spark, sf):
    none = F.lit(None).cast("string")
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label").cast("string").alias("domain"),
        F.col("vec_id").cast("string").alias("source_id"),
        none.alias("version"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _vector_queries(spark, sf):
    prepared = prepare_queries(plain_queries(spark, sf), SEARCH)
    return prepared.select("query_id", F.lit(10).alias("k"), "domains", "source_ids", "versions", "vector")


def cosine_topk(spark, sf):
    return exact_vector_hits(_vectors(spark, sf), _vector_queries(spark, sf), SEARCH).drop("source_id")


def ivf_topk(spark, sf):
    vectors = _vectors(spark, sf)
    cells = train_cells(vectors, 16)
    celled = assign_cells(vectors, cells)
    return cell_vector_hits(celled, _vector_queries(spark, sf), cells, SEARCH).drop("source_id")


def ivf_all_cells(spark, sf):
    """Trained cells, all of them probed: the same as the exact search."""
    vectors = _vectors(spark, sf)
    cells = train_cells(vectors, 16)
    every = replace(SEARCH, nprobe=16)
    return cell_vector_hits(assign_cells(vectors, cells), _vector_queries(spark, sf), cells, every).drop("source_id")


def ivf_label_cells(spark, sf):
    """Cells around the mean direction of every label, two of them probed."""
    vectors = _vectors(spark, sf)
    cells = mean_cells(vectors, "domain")
    near = replace(SEARCH, nprobe=2)
    return cell_vector_hits(assign_cells(vectors, cells), _vector_queries(spark, sf), cells, near).drop("source_id")


def scan_search(spark, sf):
    queries = filter_lists(complete_queries(plain_queries(spark, sf))).withColumn("k", F.lit(32))
    return scan_hits(chunk_table(spark, sf), queries, SEARCH).drop("source_id")


def bm25_search(spark, sf):
    queries = filter_lists(complete_queries(plain_queries(spark, sf))).withColumn("k", F.lit(32))
    return bm25_hits(chunk_table(spark, sf), queries, SEARCH, postings(spark, sf)).drop("source_id")


def word_postings(spark, sf):
    """Every word's chunks and occurrences, from the stored index."""
    index = postings(spark, sf)
    times = index.occurrences.groupBy("term").agg(F.sum("tf").alias("tf"), F.count_distinct("part").alias("filled"))
    return index.stats.join(times, "term").where("term <> ''").select("term", "df", F.col("tokens").cast("long").alias("tokens"), "tf", (F.col("filled") <= F.col("parts")).alias("dealt"))


def refreshed_postings(spark, sf):
    """The stored index after a run in which the sources of one language went and the others' titles got a new word."""
    chunks = chunk_table(spark, sf)
    gone = chunks.select("source_id").where("source_id rlike '[05]$'").distinct()
    changed = chunks.select("source_id").where("source_id rlike '[27]$'").distinct()
    new = chunks.join(changed, "source_id", "left_semi").withColumn("title", F.concat_ws(" ", "title", F.lit("Renewed")))
    index = postings(spark, sf).refreshed(new, gone.union(changed))
    return index.stats.select("term", "df", F.col("tokens").cast("long").alias("tokens"))


def metadata_filters(spark, sf):
    rows = metadata_filter(chunk_table(spark, sf), domains=[" Courses", "sports", "courses"], version="v1")
    return rows.select("chunk_id", "source_id", "domain")


def channel_sizes(spark, sf):
    n = F.length("user_text").cast("int")
    asked = questions(spark, sf).select(
        "query_id",
        F.col("user_text").alias("query_text"),
        (n - 180).alias("top_k"),
        F.when(n > 200, n).alias("vector_k"),
        F.lit(None).cast("int").alias("text_k"),
    )
    return candidate_sizes(complete_queries(asked)).select("query_id", "top_k", "vector_k", "text_k", "vector_pool")


def _hits_with_payload(spark, sf):
    """Two hit tables with repeated chunks, blank ids and ties, made of the documents."""
    docs = table(spark, sf, "documents")
    query = F.regexp_extract("source", "[0-9]+", 0).cast("bigint")
    size = F.length("text")
    base = docs.select(
        query.alias("query_id"),
        F.when(size < 60, "").otherwise(F.concat(F.lit("c"), (size / 16).cast("int").cast("string"))).alias("chunk_id"),
        "doc_id",
        "text",
        F.col("lang").alias("section"),
        entities(F.col("text"), 3).alias("entity_tags"),
        size.alias("n"),
    )

    def ranked(score):
        scored = base.withColumn("score", score)
        return top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], limit=60).select(
            "query_id", "chunk_id", "score", "rank", "text", "section", "entity_tags"
        )

    near = ranked((F.col("n") / 16).cast("int").cast("double"))
    said = ranked(F.size(F.split("text", " ")).cast("double"))
    queries = docs.groupBy(query.alias("query_id")).agg(
        F.lit(12).alias("top_k"),
        F.lit("EN").alias("section"),
        F.array(F.max("lang")).alias("sections"),
        F.array(F.lit("the"), F.lit("In"), F.lit("De")).alias("entity_tags"),
    )
    return near, said, queries


def fuse_rank(spark, sf):
    near, said, queries = _hits_with_payload(spark, sf)
    rows = fuse_hits(near, said, queries, SEARCH.weights, 6)
    return rows.select(
        "query_id", "rank", "chunk_id", "score", "vector_score", "text_score",
        joined("retrieval_channels").alias("channels"), "section",
    )


def _evidence(rows):
    return rows.select(
        "query_id", "rank", "chunk_id", "source_id", "domain", "score", "vector_score", "text_score",
        joined("retrieval_channels").alias("channels"),
    )


def hybrid_evidence(spark, sf):
    return _evidence(hybrid_search(chunk_table(spark, sf), planned_queries(spark, sf), SEARCH, postings(spark, sf)).evidence)


def query_diagnostics(spark, sf):
    found = hybrid_search(chunk_table(spark, sf), planned_queries(spark, sf), SEARCH, postings(spark, sf)).diagnostics
    return found.select(
        "query_id", "top_k", "text_mode", "vector_hits", "text_hits", "final_hits",
        joined("boost_sections").alias("boost_sections"), joined("boost_entity_tags").alias("boost_entity_tags"),
    )


def relaxed_evidence(spark, sf):
    result = search_with_relaxation(chunk_table(spark, sf), strict_queries(spark, sf), SEARCH, index=postings(spark, sf))
    return result.evidence.select("query_id", "attempt", "rank", "chunk_id", "score")


def relaxed_outcome(spark, sf):
    return search_with_relaxation(chunk_table(spark, sf), strict_queries(spark, sf), SEARCH, index=postings(spark, sf)).outcome


def text_mode_ladder(spark, sf):
    """Words of which some are never whole tokens of a chunk, so only the scan finds them."""
    words = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.regexp_replace(F.lower(F.element_at(F.split("text", " "), 2)), "^.|[^a-z]", "").alias("query_text"),
    )
    queries = filter_lists(complete_queries(words)).withColumn("k", F.lit(20)).filter("query_text <> ''")
    return lexical_hits(chunk_table(spark, sf), queries, SEARCH, postings(spark, sf)).drop("source_id")


def tag_boosts(spark, sf):
    """Shared tags of every chunk and the query with the same number."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", entities(F.col("text")).alias("tags"))
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), entities(F.col("text")).alias("wanted")
    )
    shared = tag_overlap(F.col("tags"), F.col("wanted"))
    return docs.join(asked, "doc_id").select(
        "doc_id", shared.alias("shared"), F.round(F.least(0.10 * shared, F.lit(0.20)), 6).alias("boost")
    )


def context_texts(spark, sf):
    found = hybrid_search(chunk_table(spark, sf), planned_queries(spark, sf), SEARCH, postings(spark, sf)).evidence
    context = build_context(found, 3)
    rows = answer_prompts(context, plain_queries(spark, sf))
    return rows.select("query_id", "context", "n_chunks", F.endswith("prompt", F.col("query_text")).alias("asks"))


def report_rows(spark, sf):
    queries = planned_queries(spark, sf)
    found = hybrid_search(chunk_table(spark, sf), queries, SEARCH, postings(spark, sf))
    report = evidence_report(queries, found.diagnostics, found.evidence)
    return report.select(
        "query_id",
        F.col("query.domain").alias("domain"),
        F.col("diagnostics.vector_hits").alias("vector_hits"),
        "result_count",
        joined(F.transform("evidence", lambda e: e["chunk_id"])).alias("chunk_ids"),
    )


# --- plans of queries ------------------------------------------------------------------------


def tagging_prompts(spark, sf):
    """User prompt of every chunk for a tagging model."""
    chunks = complete_documents(chunk_documents(documents(spark, sf)))
    return tag_prompts(with_rule_tags(chunks, RULES)).select("chunk_id", "prompt")


def plan_clean(spark, sf):
    """Planner answers made of the benchmark texts: clean, chatty, wrong and missing."""
    n = F.length("user_text")
    word = F.lower(F.element_at(F.split("user_text", " "), 2))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), word, F.lit("  x ")).alias("query_text"),
            (n / 6).cast("int").alias("top_k"),
            F.lit("Sports").alias("domain"),
            F.array(F.lit("sports"), F.lit("moon"), F.lit(" Finance ")).alias("domains"),
            F.array(word, F.upper(word), F.lit("Zz"), F.lit("zz")).alias("entity_tags"),
            F.array(F.lit("Fees"), F.lit("fees"), F.lit("roof")).alias("sections"),
            F.array(F.lit("a"), F.lit("A"), F.lit("b ")).alias("source_ids"),
            n.alias("vector_k"),
        )
    )
    answer = (
        F.when(n > 260, F.lit(None).cast("string"))
        .when(n > 220, F.concat(F.lit("Here: "), body))
        .when(n > 200, F.lit("[1, 2]"))
        .otherwise(body)
    )
    plans = plan_queries(questions(spark, sf).withColumn("answer", answer), "answer")
    return plans.select(
        "query_id", "query_text", "top_k", "domain", joined("domains").alias("domains"),
        "section", joined("sections").alias("sections"), joined("entity_tags").alias("entity_tags"),
        joined("source_ids").alias("source_ids"), "vector_k", "plan_valid",
    )


def query_batch(spark, sf):
    """Queries read from JSON rows, with the active filters shown."""
    rows = questions(spark, sf).select(
        "query_id",
        F.to_json(
            F.struct(
                F.col("user_text").alias("query_text"),
                F.lit(5).alias("top_k"),
                F.array(F.lit("sports")).alias("domains"),
                F.when(F.length("user_text") > 200, "v1").alias("version"),
            )
        ).alias("json"),
    )
    return active_filters(query_json(rows)).select("query_id", "query_text", "top_k", "version", "filters")


def shared_filter_batch(spark, sf):
    rows = query_texts(
        questions(spark, sf), F.col("query_id"), F.col("user_text"), top_k=6, domains=["sports"], sections=["fees"]
    )
    return active_filters(rows).select("query_id", "query_text", "top_k", "filters")


# --- stored tables ---------------------------------------------------------------------------


def _narrow(chunks):
    return chunks.select("chunk_id", "source_id", "order", "text", "version")


def _chunks(docs):
    return chunk_documents(docs).withColumn("version", F.lit("v1"))


def unseen_chunks(spark, sf):
    stored = _chunks(labelled_documents(spark, sf))
    return new_chunks_only(_chunks(documents(spark, sf)), stored).select("chunk_id", "source_id", "order")


def _batches(spark, sf):
    """Stored chunks of all documents; a new batch of labelled ones, some changed, some new, some twice."""
    stored = _narrow(_chunks(documents(spark, sf)))
    again = _narrow(_chunks(labelled_documents(spark, sf)))
    long = F.length("text") > 400
    edited = again.withColumn("version", F.when(long, "v2").otherwise(F.col("version"))).withColumn("seq", F.lit(1))
    added = again.withColumn("chunk_id", F.sha1("chunk_id")).withColumn("seq", F.lit(1))
    repeated = again.filter(long).withColumn("version", F.lit("v3")).withColumn("seq", F.lit(2))
    return stored, edited.unionByName(added).unionByName(repeated)


def upserted_chunks(spark, sf):
    stored, batch = _batches(spark, sf)
    rows = upsert_rows(stored, batch, "chunk_id", [F.desc("seq")])
    return rows.select("chunk_id", "source_id", "order", "version")


def upsert_totals(spark, sf):
    stored, batch = _batches(spark, sf)
    return upsert_counts(stored, latest_per_key(batch, "chunk_id", [F.desc("seq")]).drop("seq"))


def upserted_customers(spark, sf):
    """Records replaced by a business key."""
    stored = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    active = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal")
    )
    new = active.select("c_custkey", F.concat(F.lit("active-"), "c_custkey").alias("c_name"), "c_acctbal")
    return upsert_rows(stored, new, "c_custkey")


def kept_after_delete(spark, sf):
    """Chunks left when the sources labelled toxic are deleted."""
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    gone = table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select(
        F.concat_ws("-", "source", "doc_id").alias("source_id")
    )
    return without_sources(_chunks(documents(spark, sf)), gone).select("chunk_id", "source_id")


def incremental_states(spark, sf):
    """Documents against a manifest made of labels: equal, edited, other pipeline, no rows, new."""
    docs = table(spark, sf, "documents")
    sources = docs.select(
        F.concat_ws("-", "source", "doc_id").alias("source_id"), F.sha2("text", 256).alias("source_hash")
    )
    manifest = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.concat_ws("-", "source", "doc_id").alias("source_id"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("source_hash"),
        F.when(F.col("lang") == "en", "p1").otherwise("p0").alias("pipeline_hash"),
    )
    full = docs.filter(F.length("text") > 100).select(F.concat_ws("-", "source", "doc_id").alias("source_id"))
    rows = source_status(sources, manifest, source_counts(full), "p1")
    return rows.select("source_id", "records_in_db", "unchanged", "status")


def payload_hashes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("props").alias("json"))
    return json_payloads(rows).select("source_id", "source_path", "source_hash")


def ingest_totals(spark, sf):
    """Chunks per source collection with the grand total."""
    docs = table(spark, sf, "documents")
    chunks = _chunks(documents(spark, sf)).select("source_id")
    group = F.regexp_extract("source_id", "^src[0-9]+", 0)
    return chunks.withColumn("collection", group).rollup("collection").agg(
        F.count("*").alias("n_chunks"), F.grouping("collection").cast("int").alias("is_total")
    )


def stored_beside_new(spark, sf):
    return compare_counts(_chunks(documents(spark, sf)), _chunks(labelled_documents(spark, sf)))


def chunk_table_health(spark, sf):
    rows = table_health(chunk_table(spark, sf), 64)
    return rows.withColumn("problems", joined("problems"))


def _stored_tables(spark, buckets=8):
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    return stored_chunk_table(spark, f"{folder}/chunks", buckets), manifest_table(spark, f"{folder}/manifest", buckets)


def _customers(spark, sf):
    """Their JSON is parsed and hashed where they are read, so a table of one file is dealt to all cores first."""
    return spread(table(spark, sf, "customer"))


def incremental_run(spark, sf):
    """Two runs over the customers as JSON sources; the second one finds some of them changed."""
    chunks, manifest = _stored_tables(spark)
    customers = _customers(spark, sf)

    def payloads(rows):
        body = F.to_json(F.struct("c_name", "c_acctbal", "c_mktsegment"))
        return json_payloads(rows.select(F.concat(F.lit("customer-"), "c_custkey").alias("source_id"), body.alias("json")))

    incremental_ingest(payloads(customers), chunks, manifest, INGEST)
    changed = customers.withColumn("c_name", F.when(F.col("c_acctbal") < 0, F.lit("changed")).otherwise(F.col("c_name")))
    report = incremental_ingest(payloads(changed), chunks, manifest, INGEST).report
    return report.select("source_id", "status", "action", "new_records", "records_in_db")


STORED = ["chunk_id", "source_id", "order", "section", "text", "domain", "version"]


def _customer_versions(customers, *names):
    """Each customer as JSON once per name, a later name being a later arrival."""
    versions = F.posexplode(F.array(*names)).alias("arrival", "name")
    rows = customers.select("c_custkey", "c_mktsegment", versions)
    body = F.to_json(F.struct("name", F.col("c_mktsegment").alias("segment")))
    return json_payloads(rows.select(F.concat(F.lit("customer-"), "c_custkey").alias("source_id"), "arrival", body.alias("json")))


def _customer_runs(spark, sf):
    chunks, manifest = _stored_tables(spark)
    customers = _customers(spark, sf)
    incremental_ingest(_customer_versions(customers, F.lit("draft"), F.col("c_name")), chunks, manifest, INGEST)
    renamed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("new "), "c_name")).otherwise(F.col("c_name"))
    return chunks, incremental_ingest(_customer_versions(customers, F.lit("draft"), renamed), chunks, manifest, INGEST)


def incremental_rows(spark, sf):
    """Stored chunks after two runs, in each of which every source comes twice."""
    return _customer_runs(spark, sf)[0].read().select(*STORED)


def run_totals(spark, sf):
    return ingest_summary(_customer_runs(spark, sf)[1].report)


def _edited(docs):
    return docs.withColumn("text", F.when(F.length("text") > 200, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))


def _text_runs(spark, sf, **how):
    """Documents stored, then most of them with an edit at their end."""
    chunks, manifest = _stored_tables(spark)
    docs = documents(spark, sf)
    incremental_ingest(text_sources(docs), chunks, manifest, INGEST)
    incremental_ingest(text_sources(_edited(docs)), chunks, manifest, INGEST, **how)
    return chunks.read().select(*STORED)


def text_ingest(spark, sf):
    return _text_runs(spark, sf)


def keep_existing_ingest(spark, sf):
    """The same without clearing: chunks with other ids stay, an edit behind the part that makes the id is stored."""
    return _text_runs(spark, sf, clear_source=False)


def qna_ingest(spark, sf):
    """Conversations stored with answers that change in the second run."""
    chunks, manifest = _stored_tables(spark)
    pairs = qna_pairs(table(spark, sf, "conversations"))
    ingest_qna(pairs.withColumn("answer", F.lit("not known yet")), chunks, manifest, INGEST)
    ingest_qna(pairs, chunks, manifest, INGEST)
    return chunks.read().select(*STORED)


# --- files and hooks -------------------------------------------------------------------------


def _one_file_each(rows, form):
    """A folder in which every row has a file of its own.

    Making a file costs far more than its row does, so rows are dealt to all cores, and every task puts its files in
    their place itself (the committer's version 2), not the driver one by one. Nobody reads the folder before that.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    writer = rows.repartition(4 * spark.sparkContext.defaultParallelism).write.format(form).option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").save(folder)
    return folder


def json_file_sources(spark, sf):
    """Suppliers written as JSON files and read as sources; names of files are not compared."""
    folder = _one_file_each(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "json")
    return json_files(spark, folder).select("source_hash", "json")


def json_file_records(spark, sf):
    record = F.to_json(F.struct("s_suppkey", F.array(F.struct(F.col("s_name").alias("name"))).alias("items")))
    folder = _one_file_each(table(spark, sf, "supplier").select(F.concat(F.lit("["), record, F.lit("]"))), "text")
    rows = json_records(spark, folder, "s_suppkey long, items array<struct<name:string>>")
    return rows.select("s_suppkey", F.col("items")[0]["name"].alias("name"))


def query_files(spark, sf):
    """Files with a list of two queries and a number, which is no query."""
    first = F.to_json(F.struct(F.col("user_text").alias("query_text"), F.lit(5).alias("top_k")))
    second = F.to_json(F.struct(F.col("user_text").alias("query_text"), F.array(F.lit("sports")).alias("domains")))
    body = F.concat(F.lit("["), first, F.lit(", 7, "), second, F.lit("]"))
    asked = query_file(spark, _one_file_each(questions(spark, sf).select(body), "text"))
    return asked.select("query_text", "top_k", joined("domains").alias("domains"))


def previews(spark, sf):
    """Chunks of suppliers, a source for each nation, written for a look and read back."""
    docs = text_documents(table(spark, sf, "supplier"), F.concat(F.lit("nation-"), "s_nationkey"), F.col("s_name"))
    folder = f"{shared_folder(spark)}/previews-{uuid.uuid4().hex}"
    write_previews(chunk_documents(docs), folder)
    rows = spark.read.schema("chunk_id string, source_id string, text string, source string").json(folder)
    return rows.select("chunk_id", "source_id", "text", "source")


def embedder_hook(spark, sf):
    embed = model_embedding(lambda: lambda texts: [[len(t), t.count("e")] for t in texts])
    rows = documents(spark, sf).filter(clean(F.col("text")) != "").withColumn("v", embed(F.col("text")))
    return rows.select("source_id", F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_e"))


def answer_hook(spark, sf):
    """Answers to tagging prompts by a model that fails for chunks without a domain."""

    def ask(prompt):
        if "\nHint domain: unknown\n" in prompt:
            raise ValueError("no domain")
        return f"{len(prompt)} characters"

    prompts = tagging_prompts(spark, sf)
    return prompts.select("chunk_id", model_answer(lambda: ask)(F.col("prompt")).alias("answer"))


def chunker_hook(spark, sf):
    def sentences(text, source_id, kind):
        return [("sentence", s) for s in text.split(". ") if s]

    return custom_chunks(documents(spark, sf), sentences).select("chunk_id", "source_id", "order", "section", "text")


QUERIES = {
    "normalize_text": normalize_text,
    "tokenize_counts": tokenize_counts,
    "line_chunks": line_chunks,
    "chunk_ids": chunk_ids,
    "doc_profile": doc_profile,
    "qna_blocks": qna_text,
    "qna_chunks": qna_chunk_rows,
    "json_flatten_props": json_flatten_props,
    "json_flatten_nested": json_flatten_nested,
    "json_chunks": json_chunks,
    "record_description": record_description,
    "rule_domain": rule_domains,
    "domain_distribution": domain_counts,
    "entities": entity_tags,
    "key_fields": key_field_flags,
    "hash_embed": hash_embed,
    "embedding_dims": embedding_dims,
    "cosine_pairs": vector_pairs,
    "model_tags": model_tags,
    "build_chunks": chunk_records,
    "cosine_topk": cosine_topk,
    "ivf_topk": ivf_topk,
    "ivf_all_cells": ivf_all_cells,
    "ivf_label_cells": ivf_label_cells,
    "scan_search": scan_search,
    "bm25_search": bm25_search,
    "word_postings": word_postings,
    "refreshed_postings": refreshed_postings,
    "text_mode_ladder": text_mode_ladder,
    "metadata_filter": metadata_filters,
    "candidate_sizes": channel_sizes,
    "fuse_rank": fuse_rank,
    "hybrid_search": hybrid_evidence,
    "query_diagnostics": query_diagnostics,
    "relaxed_search": relaxed_evidence,
    "relaxed_outcome": relaxed_outcome,
    "tag_overlap_boost": tag_boosts,
    "context_build": context_texts,
    "evidence_report": report_rows,
    "tag_prompts": tagging_prompts,
    "plan_clean": plan_clean,
    "query_batch": query_batch,
    "shared_filter_batch": shared_filter_batch,
    "new_chunks_only": unseen_chunks,
    "upsert_chunks": upserted_chunks,
    "upsert_counts": upsert_totals,
    "upsert_by_business_key": upserted_customers,
    "delete_source": kept_after_delete,
    "incremental_status": incremental_states,
    "incremental_ingest": incremental_run,
    "incremental_rows": incremental_rows,
    "ingest_summary": run_totals,
    "text_ingest": text_ingest,
    "keep_existing_ingest": keep_existing_ingest,
    "qna_ingest": qna_ingest,
    "json_file_sources": json_file_sources,
    "json_file_records": json_file_records,
    "query_file": query_files,
    "write_previews": previews,
    "embedder_hook": embedder_hook,
    "answer_hook": answer_hook,
    "chunker_hook": chunker_hook,
    "payload_hash": payload_hashes,
    "ingest_report": ingest_totals,
    "compare_counts": stored_beside_new,
    "table_health": chunk_table_health,
}
