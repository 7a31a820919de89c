"""Steps that must be dealt over tasks or stay small on disk, on rows of their own."""

from pyspark.sql import functions as F

from tessera.llm.jaccard import Near, jaccard_components
from tessera.llm.lines import removed_lines
from tessera.operators import postings
from tessera.operators.lexical import bm25_hits
from tessera.plans.ingest import changed_rows, newest_sources
from tessera.sources.cut import shared_folder, temporary_tables
from tessera.sources.store import manifest_table
from workload.queries import _customers, _one_file_each


def test_one_file_each_is_written_by_many_tasks(spark):
    rows = spark.range(0, 40, 1, 1).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    folder = _one_file_each(rows, "json")
    files = spark.read.format("binaryFile").load(folder).select("path", F.decode("content", "UTF-8").alias("json")).collect()
    assert sorted(r.json.strip() for r in files) == sorted(f'{{"id":{i},"name":"n{i}"}}' for i in range(40))
    assert len({r.path.split("/part-")[1].split("-")[0] for r in files}) > 4
    assert spark.read.schema("id long, name string").json(folder).count() == 40


def _kb(spark, rows):
    """Chunk rows (chunk_id, source_id, domain, version, text) as far as the index reads them."""
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, domain string, version string, text string")
    return chunks.withColumns({"title": F.lit(None).cast("string"), "entity_tags": F.array().cast("array<string>")})


def test_postings_of_repeated_chunks(spark):
    """Equal rows, rows equal but for their words, and rows that share an id only."""
    rows = [
        ("a", "s", "d", "v", "x y x"), ("a", "s", "d", "v", "x y x"), ("a", "s", "d", "v", "x z z"), ("a", "s", None, "v", "x y"),
        (None, "s", "d", None, "y"), ("b", "t", "d", "v", ""), ("c", "t", "d", "v", None),
    ]
    want = {}
    for chunk, source, domain, version, text in rows:
        words = (text or "").split()
        for word in ["", *words]:
            key = (word, chunk, source, domain, version, len(words))
            want[key] = 1 if word == "" else want.get(key, 0) + 1
    index = postings.build_postings(_kb(spark, rows))
    named = index.lists.join(index.docs.drop("length"), ["doc", "variant"])
    got = {(r.term, r.chunk_id, r.source_id, r.domain, r.version, r.length): r.tf for r in named.collect()}
    assert got == want and named.count() == len(want)
    df = {}
    for key in want:
        df[key[0]] = df.get(key[0], 0) + 1
    assert {r.term: r.df for r in index.stats.collect()} == df


def test_postings_hold_numbers_and_scores_are_summed_where_chunks_are(spark, tmp_path):
    """No text of a chunk is stored with its words, nor are pairs of queries and chunks shuffled before they are summed."""
    chunks = _kb(spark, [(f"c{i}", f"s{i % 3}", "d", "v", f"gym hall{i % 5}") for i in range(50)])
    index = postings.build_postings(chunks).write(f"{tmp_path}/index")
    assert dict(index.lists.dtypes).get("term") == "string" and [c for c, t in index.lists.dtypes if t == "string"] == ["term"]
    none = F.array().cast("array<string>")
    asked = spark.range(4).select(F.col("id").alias("query_id"), F.concat(F.lit("gym hall"), "id").alias("query_text"), F.lit(3).alias("k"))
    found = bm25_hits(chunks, asked.withColumns({"domains": none, "source_ids": none, "versions": none}), index=index)
    assert found.count() == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("query_id" in line and "chunk_id" in line for line in dealt)


def _tables(spark):
    import os

    return {name for name in os.listdir(shared_folder(spark).removeprefix("file:")) if name.startswith("tessera-")}


def test_a_word_of_many_chunks_is_few_rows_and_a_build_leaves_few_tables(spark, tmp_path):
    rows = [(f"c{i}", f"s{i % 3}", "d", "v", f"gym gym hall{i}") for i in range(40)] + [("c1", "s9", "d", "v", "gym")]
    chunks, before = _kb(spark, rows), _tables(spark)
    with temporary_tables(spark):
        index = postings.build_postings(chunks).write(f"{tmp_path}/index")
    assert _tables(spark) == before
    gym = index.blocks.where("term = 'gym'")
    assert gym.count() < 20 and gym.select(F.sum(F.size("at"))).first()[0] == 41
    again = index.refreshed(_kb(spark, [("n1", "s1", "d", "v", "gym spa")]), spark.createDataFrame([("s1",), ("s9",)], "source_id string"))
    left = {i for i in range(40) if i % 3 != 1}
    got = again.lists.join(again.docs.drop("length", "base"), ["doc", "variant"]).where("term = 'gym'").collect()
    assert {r.chunk_id for r in got} == {f"c{i}" for i in left} | {"n1"} and len(got) == len(left) + 1
    assert {r.term: r.df for r in again.stats.collect()}["gym"] == len(left) + 1


def test_tables_of_a_step_go_with_it(spark):
    """Near copies and lines keep what their result reads, not the tables of the steps before."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(i, f"{text} {text[::-1]} {i % 4}") for i in range(12)], "doc_id long, text string")
    before = _tables(spark)
    assert {r.component_id for r in jaccard_components(docs, near=Near(3, 60, 100)).collect()} == {0}
    middle = _tables(spark)
    assert len(middle - before) <= 4
    assert removed_lines(docs).count() == 11
    assert len(_tables(spark) - middle) <= 1


def test_sources_that_come_once_are_not_brought_together(spark):
    once = spark.createDataFrame([("a", "h1"), ("b", "h2"), (None, "h3")], "source_id string, source_hash string")
    assert newest_sources(once) is once
    twice = newest_sources(once.unionByName(spark.createDataFrame([("a", "h9")], once.schema)))
    assert {(r.source_id, r.source_hash) for r in twice.collect()} == {("a", "h9"), ("b", "h2"), (None, "h3")}
    for states in ([False, False, False], [True, False, False], [True, True, False], [True, False, True]):
        status = spark.createDataFrame(list(zip(["a", "b", None], states, strict=True)), "source_id string, unchanged boolean")
        want = {s for s, same in zip("ab", states, strict=False) if not same}
        assert {r.source_id for r in changed_rows(once, status).collect()} == want


def test_stored_rows_that_stay_are_found_by_their_keys(spark, tmp_path):
    """Few or many stored rows replaced, a null key among them."""
    row = "source_id string, source_hash string, pipeline_hash string, pipeline_signature string, source_path string, records_in_db long, updated_at timestamp"
    rows = lambda ids, mark: spark.createDataFrame([(i, mark, None, None, None, 1, None) for i in ids], row)
    for ids in ("ab", "abcdefg"):
        table = manifest_table(spark, f"{tmp_path}/{ids}", 2)
        table.upsert(rows([*"abcdefgh", None], "old"))
        table.upsert(rows(ids, "new"))
        want = {(i, "new" if i in ids else "old") for i in "abcdefgh"} | {(None, "old")}
        assert {(r.source_id, r.source_hash) for r in table.read().collect()} == want
        stored = table._stored()
        assert table._rest(stored, rows("abcdefg", "x"), "source_id").count() == 2 and table._rest(stored, rows("ab", "x"), "source_id").count() == 9


def test_postings_are_shuffled_in_rounds(spark, tmp_path, monkeypatch):
    """An index is written, and searched, in rounds of some of its postings, with the rows of one round."""
    rows = [(f"c{i}", f"s{i % 7}", "d" if i % 3 else None, "v", f"gym hall{i % 5} " + "spa " * (i % 4)) for i in range(60)]
    chunks = _kb(spark, [*rows, ("c1", "s9", "d", "v", "gym"), ("c1", "s9", "d", "w", "gym pool")])
    none = F.array().cast("array<string>")
    asked = spark.range(5).select(F.col("id").alias("query_id"), F.concat(F.lit("gym spa hall"), "id").alias("query_text"), F.lit(7).alias("k"))
    asked = asked.withColumns({"domains": F.when(F.col("query_id") == 2, F.array(F.lit("d"))).otherwise(none), "source_ids": none, "versions": none})

    def found(folder):
        index = postings.build_postings(chunks).write(f"{tmp_path}/{folder}", 8)
        assert index.blocks.count() == postings.build_postings(chunks).blocks.count()
        hits = bm25_hits(chunks, asked, index=index)
        files = {r[0].split("/")[-1].split("-")[2] for r in index.blocks.select(F.input_file_name()).distinct().collect()}
        return sorted(map(tuple, hits.collect())), len(files)

    one, files = found("one")
    assert len(one) == 35 and files == 1
    monkeypatch.setattr(postings, "ROUND_POSTINGS", 60)
    several, files = found("several")
    assert several == one and files > 1


def test_an_index_holds_no_lengths_beside_words(spark, tmp_path, monkeypatch):
    """Lengths stand once per chunk; numbers of words are right after chunks of cut lists went and others came."""
    monkeypatch.setattr(postings, "PART_ROWS", 9)
    rows = [(f"c{i}", f"s{i % 3}", "d", "v", "gym " + "spa " * (i % 4)) for i in range(40)] + [("c1", "s9", "d", "v", "gym"), ("e", "s1", "d", "v", "")]
    new = [("n1", "s1", "d", "v", "gym pool pool")]
    index = postings.build_postings(_kb(spark, rows)).write(f"{tmp_path}/index")
    assert "length" not in index.blocks.columns and "length" not in index.occurrences.columns
    again = index.refreshed(_kb(spark, new), spark.createDataFrame([("s1",), ("s9",)], "source_id string"))
    built = postings.build_postings(_kb(spark, [r for r in rows if r[1] not in ("s1", "s9")] + new))
    counted = lambda i: {(r.term, r.df, r.tokens, r.parts) for r in i.stats.collect()}
    assert counted(again) == counted(built) and len(counted(again)) == 4
    said = lambda i: sorted((r.term, r.chunk_id, r.length, r.tf) for r in i.rows.collect())
    assert said(again) == said(built)
    gone = again.write(f"{tmp_path}/next").refreshed(_kb(spark, []), spark.createDataFrame([(f"s{i}",) for i in range(3)], "source_id string"))
    assert gone.stats.count() == 0 and gone.blocks.count() == 0


def test_customers_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = _customers(spark, str(tmp_path)).select("c_custkey", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.c_custkey for r in rows) == list(range(100)) and len({r.task for r in rows}) > 1
