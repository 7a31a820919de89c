"""Channels, fusion and search against brute force on small random data."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.config import FusionWeights, SearchConfig
from tessera.functions.text import tokens
from tessera.operators.fusion import fuse_hits
from tessera.operators import postings
from tessera.operators.lexical import bm25_hits, lexical_hits, scan_hits
from tessera.operators.topk import latest_per_key, top_k
from tessera.operators.vector_search import assign_cells, cell_vector_hits, exact_vector_hits, train_cells, write_cells
from tessera.plans.context import answer_prompts, build_context
from tessera.plans.search import candidate_sizes, complete_queries, hybrid_search, metadata_filter, prepare_queries
from tessera.schemas import CHUNK_RECORD
from tessera.sources.sinks import evidence_report

WORDS = ["hall", "halls", "gym", "in", "the", "fee", "fees", "x-1", "é", "Über"]
DOMAINS = ["sports", "courses", "Sports"]
CFG = SearchConfig(score_digits=6)
# The same searches through the shuffled routes.
TILED = SearchConfig(score_digits=6, block_queries=0, tile_queries=3, tile_chunks=11)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
        dim = 0 if i == 7 else 3 if i == 8 else 4
        vector = [0.0] * dim if i == 9 else [rng.uniform(-1, 1) for _ in range(dim)]
        tags = [" Gym ", "the fee"][: rng.randint(0, 2)]
        rows.append((f"c{i:02d}", f"s{i % 5}", text, vector, rng.choice(DOMAINS), tags, rng.choice(["v1", "v2"]), "Text" if i % 2 else None))
    return rows


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    rows = [
        (c, s, "txt", None, None, t, v, d, g, sec, 0, ((False,) * 4 + (None, None), {}, 0.35), ver)
        for c, s, t, v, d, g, ver, sec in corpus
    ]
    return spark.createDataFrame(rows, CHUNK_RECORD)


ASKED = [
    (0, "the gym", [], [], []), (1, "fee", ["sports"], [], []), (2, "hall in the", [], ["s1", "s2"], ["v1"]),
    (3, "é", [], [], []), (4, "gym", ["courses"], [], []), (5, "zzz", [], [], []), (6, "ÜBER x-1", [], [], []), (7, "the the", [], [], []),
]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    rows = [(i, q, d, s, v, 6, [rng.uniform(-1, 1) for _ in range(4)]) for i, q, d, s, v in ASKED]
    return spark.createDataFrame(
        rows, "query_id long, query_text string, domains array<string>, source_ids array<string>, versions array<string>, k int, vector array<double>"
    )


def allowed(row, d, s, v):
    return (not d or row[4] in d) and (not s or row[1] in s) and (not v or row[6] in v)


def best(scored, k=6):
    return [(c, s) for s, c in sorted((-s, c) for c, s in scored)][:k] and [
        (c, round(-n, 6)) for n, c in sorted((-s, c) for c, s in scored)[:k]
    ]


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("cfg", [CFG, TILED], ids=["block", "tiled"])
def test_exact_vectors(spark, corpus, chunks, asked, cfg):
    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 0.0 if len(a) != len(b) or not n else sum(x * y for x, y in zip(a, b)) / n

    got = hits(exact_vector_hits(chunks, asked, cfg))
    for r in asked.collect():
        pool = [
            (c[0], round(cosine(r.vector, c[3]), 6))
            for c in corpus
            if c[3] and allowed(c, r.domains, r.source_ids, r.versions)
        ]
        assert got.get(r.query_id, []) == best(pool)


@pytest.mark.parametrize("cfg", [CFG, TILED], ids=["block", "tiled"])
def test_scan(spark, corpus, chunks, asked, cfg):
    import re

    got = hits(scan_hits(chunks, asked, cfg))
    for i, q, d, s, v in ASKED:
        pool = []
        for c in corpus:
            text = " ".join(c[2].split()).lower()
            if not text or not allowed(c, d, s, v):
                continue
            score = 3.0 * (q.lower() in text)
            score += sum(t.lower() in text for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-]*", q))
            score += 2.0 * any(g.strip().lower() == q.lower() for g in c[5])
            if score > 0:
                pool.append((c[0], score))
        assert got.get(i, []) == best(pool), q


def plain_bm25(corpus, query, d, s, v, k1=1.2, b=0.75):
    import re

    def words(x):
        return [t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-]*", x)]

    docs = {c[0]: words(c[2] + " " + " ".join(c[5])) for c in corpus}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ws in docs.values() for t in set(ws))
    out = []
    for c in corpus:
        ws = docs[c[0]]
        tf = Counter(ws)
        score = sum(
            math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ws) / mean))
            for t in set(words(query))
            if tf[t]
        )
        if score > 0 and allowed(c, d, s, v):
            out.append((c[0], round(score, 6)))
    return best(out)


def test_bm25(spark, corpus, chunks, asked):
    got = hits(bm25_hits(chunks, asked, CFG))
    for i, q, d, s, v in ASKED:
        assert got.get(i, []) == plain_bm25(corpus, q, d, s, v), q


def test_bm25_from_stored_postings(spark, corpus, chunks, asked, tmp_path, monkeypatch):
    """Stored in buckets, common words in several parts; chunks are not read, nor are other words' buckets."""
    monkeypatch.setattr(postings, "PART_ROWS", 7)
    stored = postings.build_postings(chunks).write(f"{tmp_path}/index", buckets=5)
    assert stored.stats.where("term = 'the'").first().parts > 1 and stored.rows.where("term = 'the'").select("part").distinct().count() > 1
    broken = chunks.withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    got = hits(bm25_hits(broken, asked, CFG, stored))
    for i, q, d, s, v in ASKED:
        assert got.get(i, []) == plain_bm25(corpus, q, d, s, v), q
    one = stored.of(spark.createDataFrame([("gym",)], "term string")).rows
    assert 0 < len(one.inputFiles()) and one.select(postings.BUCKET).distinct().count() == 1
    assert "PartitionFilters: [isnotnull(word_bucket" in one._jdf.queryExecution().toString() or "word_bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert bm25_hits(chunks, asked.limit(0), CFG, stored).count() == 0
    empty = postings.build_postings(chunks.limit(0)).write(f"{tmp_path}/empty")
    assert bm25_hits(chunks.limit(0), asked, CFG, empty).count() == 0


def test_refreshed_postings_equal_new_ones(spark, chunks, tmp_path):
    new = chunks.where("source_id = 's1'").withColumn("text", F.concat_ws(" ", "text", F.lit("gym spa")))
    gone = spark.createDataFrame([("s1",), ("s3",)], "source_id string")
    stored = postings.build_postings(chunks).write(f"{tmp_path}/index").refreshed(new, gone).write(f"{tmp_path}/next")
    built = postings.build_postings(chunks.where("source_id not in ('s1', 's3')").unionByName(new))
    for name, order in (("rows", ["term", "chunk_id"]), ("stats", ["term"])):
        a, b = getattr(stored, name), getattr(built, name)
        assert a.select(*b.columns).orderBy(*order).collect() == b.orderBy(*order).collect()


def test_ladder_scans_only_silent_queries(spark, chunks, asked):
    rows = lexical_hits(chunks, asked, CFG)
    modes = {r.query_id: r.mode for r in rows.select("query_id", "mode").distinct().collect()}
    assert modes == {0: "bm25", 1: "bm25", 2: "bm25", 3: "scan", 4: "bm25", 6: "bm25", 7: "bm25"}


def test_cells_reach_the_exact_answer_when_all_are_probed(spark, chunks, asked):
    from dataclasses import replace

    usable = chunks.filter(F.size("embedding") == 4)
    cells = train_cells(usable, 4)
    celled = assign_cells(usable, cells)
    full = replace(CFG, nprobe=4)
    assert hits(cell_vector_hits(celled, asked, cells, full)) == hits(exact_vector_hits(usable, asked, CFG))
    tiled = replace(TILED, nprobe=4)
    assert hits(cell_vector_hits(celled, asked, cells, tiled)) == hits(exact_vector_hits(usable, asked, CFG))
    wide = asked.withColumn("vector_pool", F.lit(60))
    assert hits(cell_vector_hits(celled, wide, cells, tiled)) == hits(exact_vector_hits(usable, asked, CFG))
    some = hits(cell_vector_hits(celled, asked, cells, replace(CFG, nprobe=2)))
    exact = hits(exact_vector_hits(usable, asked, CFG))
    overlap = sum(len({c for c, _ in some.get(q, [])} & {c for c, _ in exact[q]}) for q in exact)
    assert overlap >= 0.5 * sum(map(len, exact.values()))


def test_stored_cells_are_searched_in_two_steps(spark, tmp_path):
    """Clustered vectors, a large cell in parts, queries in tiles: recall at 5 % of the cells, and only these are read."""
    import numpy as np
    from dataclasses import replace

    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 12))
    sizes = [900] + [40] * 39
    rows = [(f"v{i}-{k}", f"d{k % 3}", "s", "v1", [float(x) for x in centers[i] + 0.25 * r.normal(size=12)]) for i, n in enumerate(sizes) for k in range(n)]
    rows += [("none", "d0", "s", "v1", None), ("empty", "d0", "s", "v1", []), ("short", "d0", "s", "v1", [1.0])]
    table = spark.createDataFrame(rows, "chunk_id string, domain string, source_id string, version string, embedding array<double>")
    asked = [(i, 10, ["d1"] if i % 5 == 0 else [], [], [], [float(x) for x in centers[i % 40] + 0.25 * r.normal(size=12)]) for i in range(80)]
    asked += [(99, 10, [], [], [], [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, k int, domains array<string>, source_ids array<string>, versions array<string>, vector array<double>")
    cells = train_cells(table.where("size(embedding) = 12"), 40)
    celled = write_cells(assign_cells(table, cells), f"{tmp_path}/cells")
    assert celled.count() == sum(sizes)
    exact = hits(exact_vector_hits(table, queries.where("query_id < 99"), CFG))
    for tile in (100, 20_000):
        cfg = replace(CFG, nprobe=2, tile_chunks=tile, tile_queries=7)
        got = hits(cell_vector_hits(celled, queries, cells, cfg))
        assert 99 not in got and sum(len({c for c, _ in got[q]} & {c for c, _ in exact[q]}) for q in exact) >= 0.9 * sum(map(len, exact.values()))
    one = cell_vector_hits(celled, queries.where("query_id = 1"), cells, cfg)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()
    assert hits(cell_vector_hits(celled, queries, cells, replace(cfg, nprobe=40))) == exact
    assert cell_vector_hits(celled, queries.limit(0), cells, cfg).count() == 0


def test_text_of_another_column(spark, chunks):
    queries = spark.createDataFrame([(1, "gym")], "query_id long, query_text string")
    plain = hybrid_search(chunks, queries, SearchConfig(embedding_dim=4)).evidence
    renamed = chunks.withColumnRenamed("text", "body")
    named = hybrid_search(renamed, queries, SearchConfig(embedding_dim=4, text_field="body")).evidence
    columns = ["rank", "chunk_id", "text", "score"]
    assert plain.select(*columns).orderBy("rank").collect() == named.select(*columns).orderBy("rank").collect()
    assert hybrid_search(chunks, queries, SearchConfig(embedding_dim=4, text_field="none", text_mode="scan")).evidence.where("text <> ''").isEmpty()


def hit(query, chunk, score, rank, text="t", section=None, tags=()):
    return (query, chunk, score, rank, text, section, list(tags))


HIT = "query_id long, chunk_id string, score double, rank int, text string, section string, entity_tags array<string>"
QUERY = "query_id long, top_k int, section string, sections array<string>, entity_tags array<string>"


def test_boosts_reproduce_the_known_scores(spark):
    weights = FusionWeights(vector=0.5, text=0.5, overlap=0.0)
    near = spark.createDataFrame(
        [hit(1, "entry", 0.8, 1, "e", "entry_requirements"), hit(2, "cs", 0.8, 1, "c", "overview", ["Computer Science"])], HIT
    )
    said = spark.createDataFrame([hit(1, "over", 0.8, 1, "o", "overview"), hit(2, "gen", 0.8, 1, "g", "overview")], HIT)
    queries = spark.createDataFrame([(1, 2, "entry_requirements", [], []), (2, 2, None, [], ["computer science"])], QUERY)
    got = {(r.query_id, r.chunk_id): r.score for r in fuse_hits(near, said, queries, weights).collect()}
    assert got == {(1, "entry"): 0.65, (1, "over"): 0.5, (2, "cs"): 0.6, (2, "gen"): 0.5}


def plain_fusion(near, said, sections, tags, top_k, w):
    cands, order = {}, []
    for channel, rows in (("v", near), ("t", said)):
        for _, chunk, score, rank, text, section, own in rows:
            chunk = chunk.strip()
            if not chunk:
                continue
            if chunk not in cands:
                cands[chunk] = {"doc": (text, section, own)}
                order.append(chunk)
            elif len(text) > len(cands[chunk]["doc"][0]):
                cands[chunk]["doc"] = (text, section, own)
            old = cands[chunk].get(channel)
            cands[chunk][channel] = (rank if old is None else min(rank, old[0]), score)

    def part(entry, rows, weight):
        if entry is None:
            return 0.0
        rank, score = entry
        scores = [r[2] for r in rows]
        unit = 1.0 if len(rows) <= 1 else 1 - (rank - 1) / (len(rows) - 1)
        lo, hi = min(scores), max(scores)
        return weight * (0.7 * unit + 0.3 * (1.0 if hi <= lo else (score - lo) / (hi - lo)))

    out = []
    for chunk in order:
        c = cands[chunk]
        _, section, own = c["doc"]
        score = part(c.get("v"), near, w.vector) + part(c.get("t"), said, w.text)
        score += 0.2 if "v" in c and "t" in c else 0
        score += 0.15 if section and section.lower() in sections else 0
        score += min(0.1 * len({t.lower() for t in own if t} & tags), 0.2)
        out.append((round(score, 9), chunk))
    out.sort(key=lambda x: -x[0])
    return [(c, s) for s, c in out[:top_k]]


def test_fusion_on_random_hits(spark):
    rng = random.Random(1)
    near, said, queries, want = [], [], [], {}
    w = FusionWeights().normalised()
    for q in range(40):
        def channel():
            n = rng.randint(0, 9)
            scores = sorted((rng.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(n)), reverse=True)
            return [
                hit(q, rng.choice(["a", "b", "c", "d", "e", " ", "a "]), s, i + 1, "x" * rng.randint(1, 3), rng.choice([None, "Fees", "text"]), rng.sample(["A", "b", "C"], rng.randint(0, 3)))
                for i, s in enumerate(scores)
            ]
        v, t = channel(), channel()
        top = rng.randint(1, 6)
        near += v
        said += t
        queries.append((q, top, rng.choice([None, "fees"]), ["Text"], ["a", "B"]))
        sections = {x.lower() for x in [queries[-1][2], "Text"] if x}
        want[q] = plain_fusion(v, t, sections, {"a", "b"}, top, w)
    rows = fuse_hits(spark.createDataFrame(near, HIT), spark.createDataFrame(said, HIT), spark.createDataFrame(queries, QUERY))
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for q in want:
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want[q]]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_weights_are_checked():
    with pytest.raises(ValueError):
        FusionWeights(vector=-1)
    with pytest.raises(ValueError):
        FusionWeights(vector=0, text=0)
    assert FusionWeights(vector=2, text=2).normalised().text == 0.5


def test_candidate_sizes(spark):
    rows = [(1, None, None, None), (2, 3, None, 7), (3, 99, 999, 0)]
    df = spark.createDataFrame(rows, "query_id long, top_k int, vector_k int, text_k int")
    got = {r.query_id: (r.top_k, r.vector_k, r.text_k, r.vector_pool) for r in candidate_sizes(df).collect()}
    assert got == {1: (8, 32, 32, 160), 2: (3, 20, 7, 100), 3: (50, 250, 1, 1250)}


def test_metadata_filter_reaches_the_scan(spark, chunks, tmp_path):
    path = str(tmp_path / "chunks")
    chunks.write.parquet(path)
    stored = metadata_filter(spark.read.parquet(path), [" SPORTS ", ""], ["s1"], "v1").select("chunk_id")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(domain,sports)" in plan and "embedding" not in plan
    assert stored.count() == chunks.filter("domain = 'sports' and source_id = 's1' and version = 'v1'").count()


def test_hybrid_search_and_reports(spark, chunks):
    rows = [(1, " the  gym ", 3, ["SPORTS"], ["gym"], "text"), (2, "  ", 3, [], [], None), (3, "hall", 2, ["nowhere"], [], None)]
    queries = spark.createDataFrame(rows, "query_id long, query_text string, top_k int, domains array<string>, entity_tags array<string>, section string")
    cfg = SearchConfig(embedding_dim=4)
    found = hybrid_search(chunks, queries, cfg)
    evidence = found.evidence.orderBy("rank").collect()
    assert {r.query_id for r in evidence} == {1} and [r["rank"] for r in evidence] == [1, 2, 3]
    assert all(r.domain == "sports" for r in evidence)
    assert all(r.entity_tags == [t.strip() for t in r.entity_tags] for r in evidence)
    diag = {r.query_id: r for r in found.diagnostics.collect()}
    assert diag[1].final_hits == 3 and diag[1].boost_sections == ["text"] and diag[1].boost_entity_tags == ["gym"]
    assert diag[2].blank_query and diag[2].final_hits == 0
    assert diag[3].vector_hits == diag[3].text_hits == diag[3].final_hits == 0
    report = {r.query_id: r for r in evidence_report(queries, found.diagnostics, found.evidence).collect()}
    assert report[1].result_count == 3 and [e["rank"] for e in report[1].evidence] == [1, 2, 3]
    assert report[3].result_count == 0
    context = build_context(found.evidence, 2).first()
    assert context.context == " ".join(r.text for r in evidence[:2])
    prompt = answer_prompts(build_context(found.evidence, 2), queries).first().prompt
    assert context.context in prompt and "the  gym" in prompt


def test_modes_are_checked(spark, chunks):
    with pytest.raises(ValueError):
        SearchConfig(vector_mode="x")
    queries = spark.createDataFrame([(1, "gym")], "query_id long, query_text string")
    with pytest.raises(ValueError):
        hybrid_search(chunks, queries, SearchConfig(vector_mode="ivf", embedding_dim=4))


def test_top_k_two_steps_and_hot_keys(spark):
    rows = [(0 if i % 3 else i % 5, f"c{i:04d}", float(i % 97)) for i in range(3000)]
    df = spark.createDataFrame(rows, "q long, c string, s double").repartition(16)
    order = [F.desc("s"), F.col("c")]
    plain = sorted(map(tuple, top_k(df, ["q"], order, limit=7).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        assert sorted(map(tuple, top_k(df, ["q"], order, limit=7).collect())) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = top_k(df, ["q"], order, limit=7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert latest_per_key(df, "q", [F.desc("c")]).count() == df.select("q").distinct().count()


def test_prepared_queries_drop_blanks(spark):
    df = spark.createDataFrame([(1, " "), (2, "x")], "query_id long, query_text string")
    rows = prepare_queries(df, SearchConfig()).collect()
    assert [r.query_id for r in rows] == [2] and len(rows[0].vector) == 64
    assert complete_queries(df).columns[0] == "query_id"
