"""String, array and vector expressions against plain restatements of their rules."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.functions import vectors as V

SAMPLES = [
    "",
    "   ",
    " a  b\tc\n d ",
    "NBSP and　wide\x1cunit   line",
    "Café Name: x\r\nLine two\x0bthree\x85four five\x1esix",
    "The Quick Brown Fox Jumps. O'Neil-Smith's Own Éclair Shop, McDonald",
    "self_catered room-12 A_b -x _y 9z ÉA1",
    "Ärger und Übung Sehr Gut Caféteria B2b Zz",
]


def column(spark, values, name="s"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} string")


def results(df, *exprs):
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def noise(n=120):
    rng = random.Random(5)
    signs = list("aB9_- \t\n\r\x0b\x0c\x1c\x85  　.:'&éÉßZyx")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_text_rules(spark):
    values = SAMPLES + noise()
    df = column(spark, values)
    s = F.col("s")
    got = results(
        df, T.clean(s), T.strip(s), T.is_blank(s), T.tokens(s), T.non_blank_lines(s),
        T.capitalised_phrases(s), T.preview(s, 6),
    )
    for value, (clean, strip, blank, tokens, lines, phrases, preview) in zip(values, got):
        tidy = " ".join(value.split())
        assert clean == tidy
        assert strip == value.strip()
        assert blank == (not value.strip())
        assert tokens == [t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-]*", value)]
        assert lines == [x for x in value.splitlines() if x.strip()]
        assert phrases == re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z&'\-]+){0,3}\b", value)
        assert preview == (tidy if len(tidy) <= 6 else tidy[:6] + "...")


def test_titles_ids_and_paths(spark):
    df = column(spark, ["summer_fair faq", "x: y: z", "no colon"])
    got = results(df, T.title_from_stem(F.col("s")), T.split_path_value(F.col("s")))
    assert got[0][0] == "Summer Fair Faq"
    assert tuple(got[1][1]) == ("x", "y: z")
    assert got[2][1]["value"] is None
    text = "é" * 200
    row = column(spark, [text]).select(T.numbered_id(F.lit("src"), F.lit(3), F.col("s"), 120).alias("x")).first()
    assert row.x == hashlib.sha1(f"src:3:{text[:120]}".encode()).hexdigest()


def test_restore_casing(spark):
    row = column(spark, ["Where is Maple Court?"]).select(
        T.restore_casing(F.lit("maple court"), F.col("s")).alias("a"), T.restore_casing(F.lit("gym"), F.col("s")).alias("b")
    ).first()
    assert (row.a, row.b) == ("Maple Court", "gym")


def test_lists(spark):
    df = spark.createDataFrame([(["b", " A", "a", None, "", "B ", "c"],), (None,)], "v array<string>")
    got = [tuple(r) for r in df.select(A.dedupe_ci(F.col("v")), A.dedupe_ci(F.col("v"), 2), A.unique(F.col("v"), True)).collect()]
    assert got[0] == (["b", "A", "c"], ["b", "A"], ["b", "a", "c"])
    assert got[1] == ([], [], [])
    sets = df.select(A.lower_set(F.array(F.lit("X")), F.col("v")), A.only_allowed(F.array(F.lit("Fees"), F.lit("roof")), ["fees"])).first()
    assert set(sets[0]) == {"x", "b", " a", "a", "b ", "c"} and sets[1] == ["Fees"]
    maps = df.select(A.map_union(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()
    assert maps[0] == {"a": "1", "b": "3"}


@pytest.mark.parametrize("dim", [1, 32, 64, 100])
def test_hash_embedding(spark, dim):
    def plain(text):
        text = " ".join(text.split())
        if not text:
            return None
        raw = b"".join(hashlib.sha256(f"{text}|{i}".encode()).digest() for i in range(-(-dim // 32)))
        return [b / 255.0 * 2.0 - 1.0 for b in raw[:dim]]

    got = results(column(spark, SAMPLES), V.hash_embedding(F.col("s"), dim))
    assert [g[0] for g in got] == [plain(s) for s in SAMPLES]


def test_cosine_guards(spark):
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[1:5] == [0.0, 0.0, 0.0, 0.0]
    assert got[0] == pytest.approx(1.0) and got[5] == pytest.approx(1 / math.sqrt(2))


def test_casts(spark):
    df = column(spark, ["0.5", "x", None])
    assert [r[0] for r in results(df, V.to_double(F.col("s"), 9))] == [0.5, 9.0, 9.0]
    assert [r[0] for r in results(df, V.clamp(F.col("i"), 1, 1))] == [1, 1, 1]
