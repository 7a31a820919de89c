"""Ranked search, alignment of tokenizers and quality rules against plain versions, with the odd cases of each."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import anomaly, ranked
from tessera.llm.alignment import align, terminals
from tessera.llm.jaccard import jaccard_components

TERM = re.compile(ranked.TERM)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def words():
    r = random.Random(7)
    return ["".join(r.choice(("an", "the", "or", "in", "é", "st")) for _ in range(r.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="module")
def corpus(words):
    r = random.Random(8)
    pick = lambda n: " ".join(words[min(299, int(r.expovariate(0.02)))] for _ in range(n))
    rows = [(k, pick(r.randint(3, 90)) + r.choice(("", ".\n", "; X1-y2")) + pick(4)) for k in range(500)]
    rows += [(600 + k, rows[3][1]) for k in range(40)] + [(700, None), (701, ""), (702, " .,-\n"), (None, rows[5][1]), (703, pick(9000))]
    rows += [(704, "ÀÉ THE The the"), (704, "the other text of this id"), (705, "日本 the😀x \x00 \u00a0 an"), (706, "a" * 5000)]
    return rows


def plain_search(docs, items, k):
    terms = [(d, TERM.findall(lowered(t))) for d, t in docs if d is not None]
    terms = [(d, t, Counter(t)) for d, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t, _ in terms)
    df = Counter(w for _, _, c in terms for w in c)
    out = []
    for item, text in items:
        asked, found = set(TERM.findall(lowered(text))) & set(df), []
        for d, t, c in terms:
            m = 10 + (90 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in asked)
            if score > 0:
                found.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_ranked_search(spark, docs_of, corpus, words, monkeypatch):
    r = random.Random(9)
    items = [(k, " ".join(r.sample(words, r.randint(1, 30)))) for k in range(40)] + [(50, corpus[3][1]), (51, "nowhere"), (52, None), (53, "..."), (54, "THE the ÀÉ x1 Y2")]
    table = spark.createDataFrame(items + items[:2] + [(None, "the")], "item_id long, text string").withColumn("score", F.lit("x"))
    want = plain_search(corpus, items, 10)
    read = lambda df: sorted((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())
    assert read(ranked.rank_documents(docs_of(corpus), table)) == want
    # Many small shards and buckets, several blocks of items, and short steps of the search give the same rows.
    for name, value in (("SHARD_BYTES", 4000), ("BUCKET_BYTES", 3000), ("BLOCK_ITEMS", 7), ("LEAF", 1), ("WIDTH", 3)):
        monkeypatch.setattr(ranked, name, value)
    assert ranked.build_index(docs_of(corpus)).select("shard").distinct().count() > 8
    assert read(ranked.rank_documents(docs_of(corpus), table)) == want
    assert ranked.rank_documents(docs_of([]), table).count() == 0
    assert ranked.rank_documents(docs_of(corpus), table.limit(0)).count() == 0


def test_range_maxima():
    r = np.random.default_rng(4)
    term, doc = np.divmod(np.sort(r.choice(6000, 900, replace=False)), 1000)
    postings = ranked.Postings(term, doc, r.integers(0, 50, 900), 6, 1000)
    for _ in range(300):
        t = r.integers(6)
        a, b = np.sort(r.integers(postings.begins[t], postings.begins[t + 1] + 1, 2))
        at = int(postings.maxima(np.array([a]), np.array([b]))[0])
        assert postings.impact[at] == (postings.impact[a:b].max() if a < b else 0) and (a == b or a <= at < b)


def test_terminals():
    r = random.Random(3)
    successor = np.array([r.randint(k, min(999, k + 5)) if k % 50 else k for k in range(1000)])
    successor[999] = 999
    for k, end in enumerate(terminals(successor)):
        while successor[k] != k:
            k = successor[k]
        assert k == end


def plain_alignment(docs, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    rows, links = [], []
    for d, text in docs:
        if d is None:
            continue
        want, row, found = (" " + (text or "")).encode(), (0, 0, 0, 0, ""), []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and b"".join(bytes_a) == want == b"".join(bytes_b):
            i = j = end_a = end_b = 0
            groups, group_a, group_b = [], [], []
            while i < len(ids_a):
                found.append((ids_a[i], ids_b[j]))
                x, y = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
                if x <= y:
                    group_a.append(str(ids_a[i]))
                    i, end_a = i + 1, x
                if y <= x:
                    group_b.append(str(ids_b[j]))
                    j, end_b = j + 1, y
                if x == y:
                    groups.append(",".join(group_a) + "|" + ",".join(group_b))
                    group_a, group_b = [], []
            row = (len(ids_a), len(ids_b), len(groups), len(found), ";".join(groups))
        rows.append((d, *row))
        links.append(found)
    count = Counter(x for found in links for x in set(found))
    best = {}
    for (x, _), c in count.items():
        best[x] = max(c, best.get(x, 0))
    return sorted((*row, sum(count[x] == best[x[0]] for x in found), sum(count[x] for x in found)) for row, found in zip(rows, links))


def test_alignment(docs_of, corpus, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    odd = ["<|endoftext|> <s> x</s>", " two  spaces \n\n  end ", "a▁b", "\u3000wide\u2028 ﬁ e\u0301 \u180e", "don't we'll 've '", "İstanbul ß Ωmega привет 12345 ½", "\t\r\n"]
    r = random.Random(2)
    odd += ["".join(r.choice("ab c\n\u00a0é日😀▁'1.<|>") for _ in range(40)) for _ in range(60)]
    docs = corpus + [(800 + k, t) for k, t in enumerate(odd)]
    want = plain_alignment(docs, *paths)
    read = lambda df: sorted((x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups"], x["n_best"], x["count_sum"]) for x in df.collect())
    assert read(align(docs_of(docs), *paths, keep_groups=True)) == want
    monkeypatch.setattr("tessera.llm.alignment.BLOCK_BYTES", 3000)
    monkeypatch.setattr("tessera.llm.alignment.STEP_BYTES", 500)
    assert read(align(docs_of(docs), *paths, keep_groups=True)) == want
    for x in align(docs_of(docs), *paths, keep_groups=True).collect():
        assert x["groups_sha256"] == (hashlib.sha256(x["groups"].encode()).hexdigest() if x["groups"] else "")
    assert align(docs_of([]), *paths).count() == 0


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if times[w] > 1 for i in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules(spark, docs_of, corpus):
    r = random.Random(6)
    lines = ["one line\n one line\none line\n\n\none line ", "a b c d e x a b c d e", "a a a a a a a a a a a a", "# * $%&|<> é|", "x\n" * 300, "é ü\x0bñ\x1cß\x85"]
    junk = [(2000 + k, " | ".join(r.choice(("#%$", "AB!!", "x")) for _ in range(40)) + f" w{k}") for k in range(60)]
    docs = corpus + [(900 + k, t) for k, t in enumerate(lines)] + junk
    labels = spark.createDataFrame([(d, 1) for d, t in corpus[:400]] + [(d, 0) for d, _ in junk[:30]] + [(None, 1), (5, None), (6, 7)], "doc_id long, label int")
    rows = anomaly.judge_rules(docs_of(docs), labels).collect()
    read = lambda x: (x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
    assert Counter(map(read, rows)) == Counter((d, *plain_statistics(t)) for d, t in docs if d is not None)
    for x in rows:
        assert x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    kept = {x["doc_id"] for x in rows if x["kept"]}
    usual = [x["doc_id"] for x in rows if x["doc_id"] < 500 and not x["base_failed"]]
    assert not kept & {d for d, _ in junk} and sum(d in kept for d in usual) > 0.95 * len(usual)
    again = anomaly.judge_rules(docs_of(docs[::-1]), labels).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # Without labels of both kinds only the base rules judge.
    for some in (labels.limit(0), labels.where("label = 1")):
        assert all(x["kept"] == (not x["base_failed"]) for x in anomaly.judge_rules(docs_of(docs), some).collect())
    assert anomaly.judge_rules(docs_of([]), labels).count() == 0


def test_forest_paths():
    """Scores by nodes one after the other, and a value no row has is unlike all."""
    x = np.column_stack([np.random.default_rng(1).normal(size=256), np.zeros(256)])
    trees = [anomaly.grow(x, np.array([1.0, 1.0]), k) for k in range(40)]
    forest = anomaly.Forest(*(np.stack(t) for t in zip(*trees)), 256)
    rows = np.array([[0.0, 0.0], [0.1, 0.9], [9.0, 0.0]])
    got = forest.scores(rows)
    for row, score in zip(rows, got):
        total = 0.0
        for feature, value, path in trees:
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(row[feature[node]] >= value[node])
            total += path[node]
        assert math.isclose(score, 2 ** (-total / 40 / float(anomaly.mean_path(256))))
    assert got[1] > got[0] + 0.05 and got[2] > got[0] + 0.05


def test_repeated_ids_lose_no_links_and_no_lines(spark, docs_of):
    """Different texts of one doc_id: all their links count, and no line goes that stands nowhere else."""
    from tessera.llm.jaccard import jaccard_components
    from tessera.llm.lines import dedup_lines

    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(90))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a + " x"), (3, "y " + b), (4, c), (5, c + " z"), (5, ""), (6, ""), (1, a)]
    got = sorted((x["doc_id"], x["component_id"]) for x in jaccard_components(docs_of(rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]
    x, y, z, w = (text() for _ in range(4))
    rows = [(0, x), (1, f"{y}\n{x}"), (1, f"{w}\n{z}"), (1, f"{w}\n{z}"), (2, z), (None, x)]
    docs = docs_of(rows).withColumns({n: F.lit("own") for n in ("removed", "_lines", "_kept", "lines", "_removed", "text_key", "pos")})
    out = dedup_lines(docs)
    assert [c for c in docs.columns if c not in out.columns] == []
    assert sorted((k["doc_id"] is None, k["doc_id"], k["text"]) for k in out.collect()) == sorted([(False, 0, x), (False, 1, y), (False, 1, f"{w}\n{z}"), (False, 1, f"{w}\n{z}"), (False, 2, ""), (True, None, x)], key=lambda k: (k[0], k[1] or 0, k[2]))


def test_stages_with_odd_rows(spark, docs_of, tmp_path):
    """Repeated ids, rows without an id, null texts and clashing columns go through every stage without loss or gain."""
    import corpus_pipeline as p

    spark.createDataFrame([(k, k % 2) for k in range(0, 40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randint(0, 99)) for _ in range(n))
    good = [(k, text(60), "s") for k in range(1, 40, 2)]
    bad = [(k, "#%$ |||| " * 30, "s") for k in range(0, 40, 2)]
    rows = good + bad + [(1, bad[0][1], "s"), (None, good[1][1], "s"), (50, None, "t"), (51, "", None), (53, text(60), "s")] + [(53, text(30), "s"), (52, text(5), "u"), (52, text(5), "u")]
    extra = {n: F.lit("own") for n in ("removed", "copies", "score", "n_lines", "row", "row_key", "label", "_lines", "taken")}
    docs = docs_of(rows).withColumns(extra)
    kept = p.good_documents(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    texts = Counter((x["doc_id"], x["text"]) for x in kept.collect())
    assert all((d, t) in texts for d, t, _ in good) and not any((d, t) in texts for d, t, _ in bad) and (1, bad[0][1]) not in texts and (None, good[1][1]) in texts
    lines = p.unique_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.where("n_lines = 'own' and removed = 'own'").count() == lines.count()
    assert not [k for k in (50, 51, 53) if lines.where(F.col("doc_id") == k).isEmpty()]
    unique = p.unique_documents(spark, docs_of(rows + rows[:3]).withColumns(extra), str(tmp_path))
    found = Counter((x["doc_id"], x["text"]) for x in unique.collect())
    assert unique.columns == docs.columns and set(found.values()) == {1} and (53, rows[-3][1]) in found and (53, rows[-4][1]) in found
    assert [d for d, t in found if t == bad[0][1]] == [0] and all((d, t) in found for d, t, _ in good) and (None, good[1][1]) not in found
    mixed = p.mixed_sources(spark, docs, str(tmp_path))
    taken = {(x["doc_id"], x["row"]): x for x in p.mix(docs.withColumn("row", F.col("text")), also=("row",)).collect()}
    assert mixed.columns == docs.columns and len(taken) > 40
    out = Counter((x["doc_id"], x["text"]) for x in mixed.collect())
    assert all(n <= 2 * sum(1 for d, t, _ in rows if (d, t) == k) for k, n in out.items())
    for stage in (p.good_documents, p.unique_lines, p.unique_documents, p.mixed_sources, p.packed_sequences):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_bits_rule_out_no_similar_line(spark):
    """The bound from bits never rejects a pair of lines that is similar enough, at any length, and rejects unlike lines of usual lengths."""
    from tessera.llm import lines as L

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows, sets = [], {}
    for k in range(0, 400, 2):
        one = [word() for _ in range(r.choice((5, 12, 40, 300, 3000)))]
        other = [word() if r.random() < r.choice((0.01, 0.03, 0.1, 0.5)) else w for w in one]
        for key, line in ((k, " ".join(one)), (k + 1, " ".join(other))):
            rows.append((key, line))
            sets[key] = {line[i : i + 8] for i in range(len(line) - 7)}
    bits = L.shingle_bits(spark.createDataFrame(rows, "key long, line string"))
    known = lambda c, rest: bits.where(f"key % 2 = {rest}").select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    met = known("x", 0).join(known("p", 1), F.col("p") == F.col("x") + 1)
    found = met.select("x", "x_n", L.may_be_similar("x", "p", 0.8).alias("ok")).collect()
    assert len(found) == 200 and all(f["x_n"] == len(sets[f["x"]]) for f in found)
    near = {k for k in range(0, 400, 2) if 5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1])}
    passed = {f["x"] for f in found if f["ok"]}
    assert near <= passed and len(near) > 20
    unlike = {k for k in sets if k % 2 == 0 and len(sets[k] | sets[k + 1]) <= 500 and 2 * len(sets[k] & sets[k + 1]) < len(sets[k] | sets[k + 1])}
    assert len(unlike) > 20 and not unlike & passed


def test_jaccard_groups_too_large_for_a_task(docs_of):
    """Pivots meet rows of the same table, on one level after the other; the rows are those of the join in one task."""
    words = [f"w{i * 7 % 61}" for i in range(60)]
    rows = [(i, " ".join([*words[: 60 - i // 8], *[f"x{i}"] * (i % 2)])) for i in range(24)] + [(40, "nothing of this"), (41, None)]
    expected = sorted(map(tuple, jaccard_components(docs_of(rows)).collect()))
    assert len({c for _, n, c in expected if n > 1}) < 24
    assert sorted(map(tuple, jaccard_components(docs_of(rows), 3).collect())) == expected
