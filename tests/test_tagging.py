"""Tags, model answers, embeddings and finished records."""

import pytest
from pyspark.sql import functions as F

from tessera.config import IngestConfig
from tessera.operators.models import dimension_profile, model_answer, model_embedding, with_embedding
from tessera.operators.tagging import entities, key_field_map, key_fields, merge_model_tags, rule_domain, with_rule_tags
from tessera.plans.build import build_chunks
from tessera.schemas import CHUNK_RECORD


def test_rule_order(spark):
    rows = [
        ("accommodation_course", "x", "accommodation"), ("UG_list", "gym", "courses"), ("sport_faq", "x", "sports"),
        ("my_faq", "ucas", "admissions"), ("s", "The HALL has a gym", "accommodation"), ("s", "club", "sports"),
        ("s", "an offer", "admissions"), ("s", "nothing", None),
    ]
    df = spark.createDataFrame(rows, "s string, t string, want string")
    for r in df.select("want", rule_domain(F.col("s"), F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_entities_and_key_fields(spark):
    text = "\n".join(
        ["halls[0].name: Maple Court", "x.title: MAPLE court", "y: No Marker", "question: ", "z.name: a: b",
         "per_week_gbp: 1", " fees 2 ", "fees 3", "fees 4", "Entry requirements, campus, answer"]
    )
    row = spark.createDataFrame([(text,)], "t string").select(entities(F.col("t")).alias("e"), key_fields(F.col("t")).alias("k")).first()
    assert row.e[:2] == ["Maple Court", "a: b"] and "No Marker" in row.e
    assert len(row.e) == len({e.lower() for e in row.e}) <= 12
    k = row.k
    assert (k.contains_price, k.contains_entry_requirements, k.contains_location, k.contains_question_answer) == (True,) * 4
    assert k.sample_price_lines == ["per_week_gbp: 1", "fees 2", "fees 3"]
    assert k.sample_name == "Maple Court"
    none = spark.createDataFrame([("plain",)], "t string").select(key_fields(F.col("t")).alias("k")).first().k
    assert none.sample_price_lines is None and none.sample_name is None and not none.contains_price


def test_entity_cap(spark):
    text = " x ".join(f"Word{c}" for c in "abcdefghijklmnopq")
    got = spark.createDataFrame([(text,)], "t string").select(entities(F.col("t"))).first()[0]
    assert got == [f"Word{c}" for c in "abcdefghijkl"]


def test_model_answers(spark):
    answers = [
        ('{"domain": " Sports ", "entity_tags": ["A", "a", 7, null, true], "key_fields": {"k": 1}, "confidence": "0.9"}',
         ("sports", ["A", "7", "None", "True"], {"k": "1"}, 0.9)),
        ('Sure: {"domain": "music", "confidence": 7} ok', ("courses", ["Rule Tag"], {}, 1.0)),
        ("no json", ("courses", ["Rule Tag"], {}, 0.6)),
        ("[1]", ("courses", ["Rule Tag"], {}, 0.6)),
        ('{"entity_tags": "x", "key_fields": [1], "confidence": null}', ("courses", ["Rule Tag"], {}, 0.6)),
        ('{"confidence": -3}', ("courses", ["Rule Tag"], {}, 0.35)),
        (None, ("courses", ["Rule Tag"], {}, 0.35)),
    ]
    df = spark.createDataFrame(
        [(i, "course_x", "Rule Tag", a) for i, (a, _) in enumerate(answers)], "i int, source_id string, text string, answer string"
    )
    rows = merge_model_tags(with_rule_tags(df), "answer").orderBy("i").collect()
    for row, (_, want) in zip(rows, answers):
        assert (row.domain, row.entity_tags, row.extra, row.confidence) == want


def test_key_field_map_prefers_the_model(spark):
    df = spark.createDataFrame([("a.name: X",)], "t string").select(
        key_field_map(key_fields(F.col("t")), F.create_map(F.lit("sample_name"), F.lit("Y"))).alias("m")
    )
    m = df.first().m
    assert m["sample_name"] == "Y" and m["contains_price"] == "false"


def test_model_hooks(spark):
    df = spark.createDataFrame([("a  b",), ("c",)], "text string")
    embed = model_embedding(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=1)
    assert [r.embedding for r in with_embedding(df, embed=embed).collect()] == [[3.0, 1.0], [1.0, 1.0]]

    def fragile():
        def call(prompt):
            if prompt == "c":
                raise RuntimeError("down")
            return prompt.upper()
        return call

    assert [r[0] for r in df.select(model_answer(fragile)(F.col("text"))).collect()] == ["A  B", None]
    wrong = model_embedding(lambda: lambda texts: [])
    with pytest.raises(Exception):
        with_embedding(df, embed=wrong).collect()
    with pytest.raises(Exception):
        with_embedding(spark.createDataFrame([(" ",)], "text string")).collect()


def test_build_chunks_record(spark):
    docs = spark.createDataFrame([("faq_src", "json", "T", "a.name: Hall One\nb: c")], "source_id string, source_type string, title string, text string")
    cfg = IngestConfig(version="v9")
    out = build_chunks(docs, cfg)
    assert [f.name for f in out.schema] == [f.name for f in CHUNK_RECORD]
    r = out.first()
    assert (r.domain, r.version, r.section, r.order, len(r.embedding)) == ("admissions", "v9", "json_fields", 0, 64)
    assert r.metadata.key_fields.sample_name == "Hall One" and r.metadata.confidence == 0.35
    asked = build_chunks(docs, cfg, tagger=model_answer(lambda: lambda p: '{"domain": "sports", "confidence": 0.8}'))
    r2 = asked.first()
    assert (r2.domain, r2.metadata.confidence) == ("sports", 0.8)
    assert build_chunks(docs, cfg, existing=out).count() == 0


def test_dimension_profile(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([3.0, 4.0],)], "embedding array<double>")
    got = {r.dim: (r.n, r.matches_query) for r in dimension_profile(df, 2).collect()}
    assert got[2] == (2, True) and got[1] == (1, False)
