"""Sources to chunks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkRules
from tessera.functions.jsonwalk import canonical_json_hash, json_lines
from tessera.operators.chunking import (
    chunk_documents,
    custom_chunks,
    json_documents,
    qna_blocks,
    qna_chunks,
    record_text,
)
from tessera.operators.health import document_profile
from tessera.operators.numbering import running_start
from tessera.plans.build import complete_documents


def lines_of(spark, text):
    return spark.createDataFrame([(text,)], "j string").select(json_lines(F.col("j"))).first()[0]


def test_json_lines_edge_cases(spark):
    text = (
        '{"b":{"x":[1,2.50,{"q":"[1]","z":null}],"e":[],"o":{}},"a":"null","t":true,"s":"true",'
        '"d.d":"li\\nne","blank":"  ","n":1e3,"big":1e22,"i":12345678901234567890123}'
    )
    assert lines_of(spark, text) == [
        "b.x[0]: 1", "b.x[1]: 2.5", "b.x[2].q: [1]", "b.x[2].z: None", "a: null", "t: True", "s: true",
        "d.d: li\nne", "n: 1000.0", "big: 1e+22", "i: 12345678901234567890123",
    ]
    assert lines_of(spark, '[1,["x"]]') == ["[0]: 1", "[1][0]: x"]
    assert lines_of(spark, "5") == [": 5"]
    deep = '{"a":' * 60 + "1" + "}" * 60
    assert lines_of(spark, deep) == [".".join("a" * 60) + ": 1"]
    assert lines_of(spark, '{"a":1,"b":2,"a":3}') == ["a: 3", "b: 2"]


def test_bad_json_stops_the_job(spark):
    with pytest.raises(Exception):
        lines_of(spark, '{"a": 1')


def test_canonical_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [2]}',), ('{"b":[2],"a":1}',), ('{"a":2}',)], "j string")
    a, b, c = [r[0] for r in df.select(canonical_json_hash(F.col("j"))).collect()]
    assert a == b != c


def faq(sections, pairs):
    return {
        "source_url": "u", "scraped_at": "2026-01-01",
        "sections": [
            {"section_title": f"s{i}", "faqs": [{"question": f"q{i}.{k}", "answer": "a"} for k in range(n)]}
            for i, n in enumerate(pairs)
        ][:sections],
    }


@pytest.mark.parametrize("pairs,leaves,chunks", [([5, 4, 4, 4, 4, 4, 4, 4], 76, 3), ([8, 8], 36, 2)])
def test_faq_source_sizes(spark, pairs, leaves, chunks):
    rows = [("faq", json.dumps(faq(len(pairs), pairs)))]
    docs = json_documents(spark.createDataFrame(rows, "source_id string, json string"))
    assert docs.select(F.size(F.split("text", "\n"))).first()[0] == leaves
    got = chunk_documents(complete_documents(docs)).orderBy("order").collect()
    assert [r.order for r in got] == list(range(chunks))
    assert {r.section for r in got} == {"json_fields"}


def test_line_windows_and_ids(spark):
    text = "\n".join(f"line {i}" if i % 7 else "  " for i in range(100)) + "\n"
    rows = [("a", "txt", text), ("b", "txt", " \n\n"), ("c", "txt", "one"), ("w", "web", "x --- y\n---\n --- ---z")]
    docs = spark.createDataFrame(rows, "source_id string, source_type string, text string")
    got = chunk_documents(docs, ChunkRules(text_lines=10)).orderBy("source_id", "order").collect()
    kept = [x for x in text.splitlines() if x.strip()]
    wanted = [("a", i, "\n".join(kept[i * 10 : i * 10 + 10])) for i in range(-(-len(kept) // 10))]
    wanted += [("c", 0, "one")] + [("w", i, t) for i, t in enumerate(["x", "y", "z"])]
    assert [(r.source_id, r.order, r.text) for r in got] == wanted
    for r in got:
        assert r.chunk_id == hashlib.sha1(f"{r.source_id}:{r.order}:{r.text[:120]}".encode()).hexdigest()


def test_qna_chunks_number_across_pairs(spark):
    rows = [
        ("s", 0, " q0 ", "a0"), ("s", 1, "", "lost"), ("s", 2, "q2", "one --- two"), ("s", 10, "q10", None), ("t", 5, "q", "a"),
    ]
    pairs = spark.createDataFrame(rows, "source_id string, pos long, question string, answer string")
    got = qna_chunks(qna_blocks(pairs)).orderBy("source_id", "order").collect()
    assert [(r.source_id, r.order, r.text) for r in got] == [
        ("s", 0, "Q: q0\nA: a0"), ("s", 1, "Q: q2\nA: one"), ("s", 2, "two"), ("s", 3, "Q: q10\nA:"), ("t", 0, "Q: q\nA: a"),
    ]
    assert {r.section for r in got} == {"qna"}


def test_running_start_over_blocks(spark):
    rows = [("g", i, i % 3) for i in range(200)] + [("h", 3, 5)]
    df = spark.createDataFrame(rows, "g string, p long, w int")
    got = {(r.g, r.p): r.s for r in running_start(df, "g", "p", "w", "s", block=7).collect()}
    total = 0
    for g, p, w in rows[:200]:
        assert got[(g, p)] == total
        total += w
    assert got[("h", 3)] == 0


def test_custom_chunker(spark):
    docs = spark.createDataFrame([("a", "txt", "x|y"), ("b", "txt", "")], "source_id string, source_type string, text string")
    got = custom_chunks(docs, lambda text, source, kind: [(source, t) for t in text.split("|") if t]).orderBy("order").collect()
    assert [(r.source_id, r.order, r.section, r.text) for r in got] == [("a", 0, "a", "x"), ("a", 1, "a", "y")]


def test_record_text(spark):
    schema = (
        "name string, type string, address string, short_description string, catering_type string, services array<string>, "
        "facilities array<string>, room_types array<struct<name:string,ensuite:boolean,occupancy:string,tenancy_weeks:int,"
        "prices:array<struct<per_week_gbp:double,total_contract_gbp:double>>>>"
    )
    rooms = [("Big", True, "single", 40, [(150.5, 6000.0), (1.0, 2.0)]), ("Small", None, None, None, [])]
    df = spark.createDataFrame(
        [("H", "hall", "", None, "self_catered", ["a", "b"], [], rooms), (None,) * 8], schema
    )
    full, empty = [r[0] for r in df.select(record_text()).collect()]
    assert full.split("\n") == [
        "Hall name: H", "Type: hall", "Catering: self catered", "Services: a; b",
        "Room type: Big, en-suite, single occupancy, 40 weeks tenancy, £150.5 per week (£6000.0 total)",
        "Room type: Small, shared bathroom,  occupancy,  weeks tenancy",
    ]
    assert empty == ""


def test_document_profile(spark):
    docs = spark.createDataFrame([("a", "x\n\ny\n"), ("b", "")], "source_id string, text string")
    got = {r.source_id: (r.n_chars, r.n_lines, r.n_full_lines, r.n_chunks) for r in document_profile(docs, 1).collect()}
    assert got == {"a": (5, 3, 2, 2), "b": (0, 0, 0, 0)}
