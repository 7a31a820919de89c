"""Query plans, relaxation, ingest runs, tables and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkRules, IngestConfig, SearchConfig
from tessera.operators.health import compare_counts, source_status, table_health
from tessera.operators.models import model_answer
from tessera.operators.topk import top_k
from tessera.operators.upsert import upsert_counts, upsert_rows, without_sources
from tessera.plans.build import build_chunks
from tessera.plans.ingest import incremental_ingest, ingest_qna, pipeline_hash, text_sources
from tessera.plans.planner import PLAN_TASK, active_filters, plan_prompts, plan_queries
from tessera.schemas import QUERY
from tessera.plans.relax import search_with_relaxation
from tessera.plans.search import hybrid_search, prepare_queries
from tessera.sources.files import json_files, json_records
from tessera.sources.payloads import json_payloads, qna_pairs
from tessera.sources.queries import query_file, query_json, query_texts
from tessera.sources.sinks import write_previews, write_report
from tessera.sources.store import chunk_table, manifest_table
from tessera.streaming.watch import watch_folder


def test_plans_without_a_model(spark):
    df = spark.createDataFrame([(1, "  Maple   Court "), (2, " ")], "query_id long, user_text string")
    rows = plan_queries(df).collect()
    assert [(r.query_id, r.query_text, r.top_k, r.domains, r.domain) for r in rows] == [(1, "Maple Court", 8, [], None)]
    prompts = plan_prompts(df).first()
    assert prompts.prompt == "  Maple   Court \n(cleaned: Maple Court)"
    assert prompts.system_prompt == plan_prompts(df, task="Do this.").first().system_prompt.replace("Do this.", PLAN_TASK)
    told = dict(line[2:].split(": ", 1) for line in prompts.system_prompt.split("\n")[1:])
    assert list(told) == [f.name for f in QUERY] and told["top_k"].startswith("a whole number from 1 to 50") and "sports" in told["domain"]


GOOD = {
    "query_text": " maple  court price ", "top_k": "12", "domain": "Accommodation", "domains": ["accommodation", "moon", "Sports"],
    "entity_tags": ["maple court", "MAPLE COURT", " ", "Gym"], "section": "Fees", "sections": ["fees", "roof", "qna"],
    "source_ids": ["a", "A", "b"], "version": "v1", "vector_k": 40, "text_k": None, "extra": 1,
}


CHANGES = [
    ({}, True), ({"top_k": 0}, False), ({"top_k": 51}, False), ({"top_k": 5.5}, False), ({"top_k": 5.0}, True), ({"top_k": None}, False),
    ({"query_text": None}, False), ({"query_text": 3}, False), ({"domain": 3}, False), ({"domain": None}, True),
    ({"domains": None}, False), ({"domains": [1]}, False), ({"domains": "x"}, False), ({"vector_k": 251}, False), ({"vector_k": True}, True),
    ({"version": None}, True), ({"sections": []}, True), ({"top_k": "x"}, False),
]


def test_plan_validation(spark):
    text = "How much is Maple Court?"
    rows = [(i, text, json.dumps({**GOOD, **change})) for i, (change, _) in enumerate(CHANGES)]
    df = spark.createDataFrame(rows, "query_id long, user_text string, answer string")
    for r in plan_queries(df, "answer").collect():
        if not CHANGES[r.query_id][1]:
            assert (r.query_text, r.top_k, r.domains, r.entity_tags, r.plan_valid) == (text, 8, [], [], False)
            continue
        assert r.plan_valid and r.query_text == "maple court price"
        assert r.domains[0] == r.domain
        assert r.entity_tags == ["Maple Court", "Gym"] and r.source_ids == ["a", "b"]


def test_plan_cleaning(spark):
    df = spark.createDataFrame(
        [(1, "Q Maple Court", "note " + json.dumps(GOOD) + " end"), (2, "Q", "junk"), (3, "Q", None)],
        "query_id long, user_text string, answer string",
    )
    a, b, c = plan_queries(df, "answer").orderBy("query_id").collect()
    assert (a.domains, a.sections, a.section, a.top_k, a.vector_k, a.text_k, a.version) == (
        ["accommodation", "sports"], ["Fees", "qna"], "Fees", 12, 40, None, "v1",
    )
    assert (b.query_text, b.top_k, b.domains) == ("Q", 8, []) and (c.query_text, c.top_k) == ("Q", 8)


def test_active_filters(spark):
    df = spark.createDataFrame(
        [(1, "sports", [], ["t"], None, ["fees"], [], None), (2, None, [], [], None, [], [], None)],
        "query_id long, domain string, domains array<string>, entity_tags array<string>, section string, sections array<string>, source_ids array<string>, version string",
    )
    shown = [r.filters for r in active_filters(df).orderBy("query_id").collect()]
    assert json.loads(shown[0]) == {"domains": ["sports"], "entity_tags": ["t"], "sections": ["fees"]} and shown[1] == "{}"


def docs(spark, n=12):
    rows = [(f"sport_{i}" if i % 2 else f"course_{i}", f"Topic {i} about gym number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, text string")


def test_relaxation(spark):
    chunks = build_chunks(docs(spark))
    queries = spark.createDataFrame(
        [(1, "gym", "Gym?", ["sports"], []), (2, "topic", "Topic?", ["finance"], ["sport_1"]), (3, "number", "number 4", ["finance"], ["nope"]),
         (4, " ", " ", [], [])],
        "query_id long, query_text string, user_text string, domains array<string>, source_ids array<string>",
    ).withColumn("top_k", F.lit(3))
    result = search_with_relaxation(chunks, queries, SearchConfig())
    used = {r.query_id: (r.attempt_used, r.result_count) for r in result.outcome.collect()}
    assert used == {1: (1, 3), 2: (2, 1), 3: (3, 3), 4: (None, 0)}
    log = sorted((r.query_id, r.attempt, r.hits) for r in result.attempts.collect())
    assert log == [(1, 1, 3), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 0), (3, 3, 3), (4, 1, 0), (4, 2, 0), (4, 3, 0)]
    diag = {r.query_id: r.attempt for r in result.diagnostics.collect()}
    assert diag == {1: 1, 2: 2, 3: 3, 4: 3}
    ranks = {(r.query_id, r["rank"]) for r in result.evidence.collect()}
    assert len(ranks) == result.evidence.count() == 7


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1), ("a", 1, 1)], "chunk_id string, v int, seq int")
    rows = upsert_rows(old, new, newest=[F.desc("seq")])
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 4), ("c", 5)]
    counts = upsert_counts(old, spark.createDataFrame([("a", 1), ("b", 4), ("c", 5)], "chunk_id string, v int")).first()
    assert (counts.upserted_count, counts.matched_count, counts.modified_count) == (1, 2, 1)
    left = without_sources(spark.createDataFrame([("s", 1), ("t", 2)], "source_id string, v int"), spark.createDataFrame([("s",), ("s",)], "source_id string"))
    assert [tuple(r) for r in left.collect()] == [("t", 2)]


def test_source_status(spark):
    sources = spark.createDataFrame([(x, "h") for x in "abcde"], "source_id string, source_hash string")
    manifest = spark.createDataFrame([("a", "h", "p"), ("b", "x", "p"), ("c", "h", "old"), ("d", "h", "p")], "source_id string, source_hash string, pipeline_hash string")
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "source_id string, records_in_db long")
    got = {r.source_id: (r.status, r.unchanged, r.records_in_db) for r in source_status(sources, manifest, counts, "p").collect()}
    assert got == {
        "a": ("unchanged", True, 2), "b": ("source_changed", False, 1), "c": ("pipeline_changed", False, 1),
        "d": ("missing_records", False, 0), "e": ("new", False, 0),
    }


def test_table_changes(spark, tmp_path):
    table = chunk_table(spark, str(tmp_path / "kb"), buckets=8)
    assert table.read().count() == 0
    chunks = build_chunks(docs(spark))
    table.upsert(chunks)
    assert table.read().count() == 12
    table.upsert(chunks.filter("source_id = 'sport_1'").withColumn("version", F.lit("v2")))
    assert table.read().filter("version = 'v2'").count() == 1 and table.read().count() == 12
    assert table.scan_sources(["sport_1", "course_2"]).count() == 2
    queries = spark.createDataFrame([(1, "topic 3 gym", 4)], "query_id long, query_text string, top_k int")
    plain = hybrid_search(table.read(), queries).evidence
    stored = hybrid_search(table, queries).evidence
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
    assert "kb_bucket" in stored._jdf.queryExecution().executedPlan().toString()
    gone = chunks.filter("domain = 'sports'").select("source_id")
    table.delete_sources(gone)
    assert {r.domain for r in table.read().select("domain").distinct().collect()} == {"courses"}
    table.delete_sources(chunks.select("source_id"))
    assert table.read().count() == 0


def write_sources(folder, contents):
    folder.mkdir(exist_ok=True)
    for name, body in contents.items():
        (folder / name).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")


def test_incremental_ingest(spark, tmp_path):
    folder = tmp_path / "data"
    body = {"name": "Hall", "items": [{"k": i} for i in range(70)]}
    write_sources(folder, {"hall_list.json": body, "sport_faq.json": {"q": "é"}, "x_chunk_records_preview.json": {"no": 1}, "note.txt": "no"})
    table = chunk_table(spark, str(tmp_path / "kb"), buckets=4)
    manifest = manifest_table(spark, str(tmp_path / "manifest"), buckets=2)
    cfg = IngestConfig()

    def run(**kw):
        result = incremental_ingest(json_files(spark, str(folder)), table, manifest, kw.pop("cfg", cfg), **kw)
        rows = {r.source_id: (r.action, r.status, r.new_records, r.records_in_db) for r in result.report.collect()}
        return rows, result.summary.first()

    rows, total = run()
    assert rows == {"hall_list": ("ingested", "new", 3, 3), "sport_faq": ("ingested", "new", 1, 1)}
    assert (total.total_sources_seen, total.total_new_records) == (2, 4)
    assert table.read().filter("source_id = 'hall_list'").select("title").first().title == "Hall List"
    rows, total = run()
    assert {r[0] for r in rows.values()} == {"skipped"} and total.total_new_records == 0
    write_sources(folder, {"sport_faq.json": {"q": "changed"}})
    rows, _ = run()
    assert rows["sport_faq"] == ("ingested", "source_changed", 1, 1) and rows["hall_list"][0] == "skipped"
    assert table.read().filter("source_id = 'sport_faq'").first().text == "q: changed"
    newer = IngestConfig(version="v2")
    assert pipeline_hash(newer) != pipeline_hash(cfg)
    rows, _ = run(cfg=newer)
    assert {r[1] for r in rows.values()} == {"pipeline_changed"}
    rows, _ = run(cfg=newer, incremental=False, clear_source=False)
    assert all(r[0] == "ingested" and r[2] == 0 for r in rows.values())
    before = table.read().count()
    write_sources(folder, {"hall_list.json": "{broken"})
    with pytest.raises(Exception):
        run(cfg=newer)
    assert table.read().count() == before
    write_sources(folder, {"hall_list.json": {}})
    rows, _ = run(cfg=newer)
    assert rows["hall_list"] == ("ingested", "source_changed", 0, 0)
    assert table.read().filter("source_id = 'hall_list'").count() == 0
    one = json_files(spark, str(folder), "sport_faq.json").collect()
    assert [r.source_id for r in one] == ["sport_faq"]
    with pytest.raises(Exception):
        json_files(spark, str(folder), "missing.json").collect()


def test_payload_ingest(spark, tmp_path):
    table, manifest = chunk_table(spark, str(tmp_path / "kb"), 2), manifest_table(spark, str(tmp_path / "m"), 2)
    first = spark.createDataFrame([("p", '{"a": 1, "b": 2}')], "source_id string, json string")
    again = spark.createDataFrame([("p", '{"b": 2, "a": 1}')], "source_id string, json string")
    assert incremental_ingest(json_payloads(first), table, manifest).summary.first().total_new_records == 1
    assert incremental_ingest(json_payloads(again), table, manifest).summary.first().skipped_sources == 1


def test_a_run_that_stops_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    table = chunk_table(spark, str(tmp_path / "kb"), buckets=1)
    table.upsert(build_chunks(docs(spark)))
    before = sorted(r.chunk_id for r in table.read().collect())
    new = build_chunks(docs(spark)).filter("source_id = 'sport_1'").withColumn("version", F.lit("v2"))

    def stop(*_):
        raise RuntimeError("the run ends here")

    with monkeypatch.context() as patched:
        patched.setattr(type(table), "_switch", stop)
        with pytest.raises(RuntimeError):
            table.upsert(new)
        with pytest.raises(RuntimeError):
            table.delete_sources(new)
    assert sorted(r.chunk_id for r in table.read().collect()) == before
    assert table.read().filter("version = 'v2'").count() == 0
    table.upsert(new)
    table.vacuum()
    assert sorted(r.chunk_id for r in table.read().collect()) == before and len(list((tmp_path / "kb" / "data").iterdir())) == 1
    assert chunk_table(spark, str(tmp_path / "kb"), buckets=9).read().count() == len(before)


def test_of_two_runs_at_once_one_stops(spark, tmp_path):
    table = chunk_table(spark, str(tmp_path / "kb"), buckets=2)
    base = table._snapshot()
    folder = table._write(build_chunks(docs(spark)))
    table._switch(folder, [0, 1], base)
    with pytest.raises(RuntimeError):
        table._switch(folder, [0, 1], base)
    assert table.read().count() == 12


def test_newest_copy_of_a_source(spark, tmp_path):
    table, manifest = chunk_table(spark, str(tmp_path / "kb"), 2), manifest_table(spark, str(tmp_path / "m"), 2)
    rows = [("p", 1, '{"a": "old"}'), ("p", 3, '{"a": "new"}'), ("p", None, '{"a": "no time"}'), ("q", 2, '{"a": "other"}'), ("q", 2, '{"a": "other"}')]
    sources = json_payloads(spark.createDataFrame(rows, "source_id string, arrival int, json string"))
    report = incremental_ingest(sources, table, manifest).report
    assert sorted((r.source_id, r.new_records) for r in report.collect()) == [("p", 1), ("q", 1)]
    assert sorted(r.text for r in table.read().collect()) == ["a: new", "a: other"]
    assert manifest.read().count() == 2


def test_an_edit_behind_the_id_is_kept(spark, tmp_path):
    table, manifest = chunk_table(spark, str(tmp_path / "kb"), 2), manifest_table(spark, str(tmp_path / "m"), 2)

    def run(text):
        rows = spark.createDataFrame([("s", text)], "source_id string, text string")
        return incremental_ingest(text_sources(rows), table, manifest, clear_source=False).summary.first()

    run("x" * 150 + " old")
    assert run("x" * 150 + " new").total_new_records == 1
    assert [r.text[-3:] for r in table.read().collect()] == ["new"]
    assert run("x" * 150 + " new").skipped_sources == 1


def test_qna_ingest(spark, tmp_path):
    table, manifest = chunk_table(spark, str(tmp_path / "kb"), 2), manifest_table(spark, str(tmp_path / "m"), 2)
    turns = [(1, 0, "user", "Where?"), (1, 1, "assistant", "Here."), (1, 2, "user", "When?"), (2, 0, "user", None)]
    pairs = qna_pairs(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert ingest_qna(pairs, table, manifest).summary.first().total_new_records == 2
    assert [r.text for r in table.read().orderBy("order").collect()] == ["Q: Where?\nA: Here.", "Q: When?\nA:"]
    again = {r.source_id: r.status for r in ingest_qna(pairs, table, manifest).report.collect()}
    assert again == {"conv-1": "unchanged", "conv-2": "missing_records"}


def test_failed_model_calls(spark):
    def fail(prompt):
        raise ValueError("no answer")

    rows = spark.createDataFrame([("p",)], "prompt string")
    assert rows.select(model_answer(lambda: fail)(F.col("prompt")).alias("a")).first().a is None
    with pytest.raises(Exception, match="no answer"):
        rows.select(model_answer(lambda: fail, stop=True)(F.col("prompt"))).collect()


def test_more_rows_than_a_ranking_keeps(spark):
    rows = spark.range(4).withColumns({"q": F.lit(1), "k": F.lit(3)})
    assert top_k(rows, ["q"], [F.asc("id")], limit=3, k="k").count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        top_k(rows, ["q"], [F.asc("id")], limit=2, k="k").collect()


def test_sizes_out_of_range_stop_a_search(spark):
    def sizes(top_k, vector_k):
        rows = spark.createDataFrame([(1, "gym", top_k, vector_k)], "query_id long, query_text string, top_k int, vector_k int")
        return prepare_queries(rows, SearchConfig()).select("top_k", "vector_k", "text_k").first()

    assert tuple(sizes(None, 250)) == (8, 250, 32)
    for wrong in ((51, None), (0, None), (8, 251)):
        with pytest.raises(Exception, match="must be between"):
            sizes(*wrong)


def test_watch_folder(spark, tmp_path):
    folder = tmp_path / "in"
    write_sources(folder, {"a.json": {"x": 1}})
    table, manifest = chunk_table(spark, str(tmp_path / "kb"), 2), manifest_table(spark, str(tmp_path / "m"), 2)
    for _ in range(2):
        query = watch_folder(spark, str(folder), table, manifest, str(tmp_path / "progress"))
        query.awaitTermination(120)
        write_sources(folder, {"b.json": {"y": 2}})
    assert sorted(r.text for r in table.read().collect()) == ["x: 1", "y: 2"]


def test_query_sources(spark, tmp_path):
    write_sources(tmp_path / "q", {"list.json": [{"query_text": "a", "top_k": 5, "domains": ["d"]}, 7, "x", {"query_text": "b"}], "one.json": {"query_text": "c"}})
    rows = query_file(spark, str(tmp_path / "q")).collect()
    assert sorted(r.query_text for r in rows) == ["a", "b", "c"] and len({r.query_id for r in rows}) == 3
    assert [r.top_k for r in rows if r.query_text == "a"] == [5]
    write_sources(tmp_path / "bad", {"n.json": "5"})
    with pytest.raises(Exception):
        query_file(spark, str(tmp_path / "bad")).collect()
    inline = spark.createDataFrame([(1, '{"query_text": "a"}')], "query_id long, json string")
    assert query_json(inline).first().query_text == "a"
    with pytest.raises(Exception):
        query_json(spark.createDataFrame([(1, "[1]")], "query_id long, json string")).collect()
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string")
    shared = query_texts(texts, F.col("i"), F.col("t"), domains=["d"], version="v1", vector_k=9).collect()
    assert [(r.query_text, r.top_k, r.domains, r.version, r.vector_k) for r in shared] == [("a", 6, ["d"], "v1", 9), ("b", 6, ["d"], "v1", 9)]


def test_records_and_pairs(spark, tmp_path):
    write_sources(tmp_path / "r", {"halls.json": [{"name": "A", "services": ["x"]}, {"name": "B"}]})
    rows = json_records(spark, str(tmp_path / "r"), "name string, services array<string>").collect()
    assert sorted((r.name, r.services) for r in rows) == [("A", ["x"]), ("B", None)]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "late")], "conv_id long, turn long, role string, text string")
    pairs = {(r.pos, r.question, r.answer) for r in qna_pairs(turns).collect()}
    assert pairs == {(1, "q", "a"), (3, "late", None)}


def test_health_and_counts(spark, tmp_path):
    rows = [("a", [1.0]), ("a", [1.0, 2.0]), (" ", [1.0]), ("b", None)]
    health = table_health(spark.createDataFrame(rows, "chunk_id string, embedding array<double>"), 3).first()
    assert (health.n_rows, health.n_ids, health.n_duplicates, health.n_blank_ids, health.n_no_embedding) == (4, 2, 1, 1, 1)
    assert len(health.problems) == 5 and not health.healthy
    chunks = build_chunks(docs(spark, 3))
    assert table_health(chunks, 64).first().healthy
    both = {r.source_id: (r.local_records, r.stored_records) for r in compare_counts(chunks, chunks.filter("source_id = 'sport_1'")).collect()}
    assert both == {"course_0": (1, 0), "sport_1": (1, 1), "course_2": (1, 0)}
    write_previews(chunks, str(tmp_path / "preview"))
    assert spark.read.json(str(tmp_path / "preview")).count() == 3
    write_report(chunks.select("chunk_id"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_chunk_rules_are_checked():
    with pytest.raises(ValueError):
        ChunkRules(text_lines=0)
