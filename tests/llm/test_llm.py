"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, media, nearest, urls
from tessera.llm.components import connected_components
from tessera.llm.jaccard import jaccard_components
from tessera.llm.lines import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.packing import pack, pack_lengths
from tessera.llm.quality import score, train
from tessera.llm.repeats import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("an", "the", "or", "in", "é", "st")) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(k, 120) for k in range(12)]
    near = base[3].split(" ")
    near[60] = "changed"
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[3], "s1"), (21, " ".join(near), None), (22, None, "s1"), (23, "", "s2"), (24, "one", None), (25, "one two", "s0")]
    rows += [(26, prose(99, 6000), "s2"), (27, base[0][:200] + " x " + base[5][300:500], "s0"), (27, base[0][:200] + " x " + base[5][300:500], "s0")]
    rows += [(None, "no id", "s0"), (28, "\n\n \t", "s0"), (29, base[7] + "\n" + base[8], "s1")]
    return rows


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 5), (4, 4), (None, 1), (2, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 5, 8: 5, 7: 5, 5: 5}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_pack(docs_of, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = pack(docs_of(corpus), path, 256).collect()
    want = Counter()
    for doc, text, _ in corpus:
        if doc is not None:
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            for p in range(0, len(ids), 256):
                part = ids[p : p + 256]
                want[(doc, p // 256, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:])) and sum(n for _, n in placed) <= 256
    assert len(by) <= -(-sum(r["length"] for r in rows) // 256) + 2
    assert pack(docs_of([]), path, 256).count() == 0


def test_pack_lengths():
    histogram = {700: 3, 300: 3, 500: 2, 250: 1, 125: 2, 1000: 4}
    patterns = pack_lengths(histogram, 1000)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 1000
        for length in pattern:
            used[length] += times
    assert used == Counter(histogram) and sum(n for _, n in patterns) == 9


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] + [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0, 10, 1.0, 150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    for q, hits in got.items():
        s = (x * x[q]).sum(axis=1)
        want = sorted((-s[i], i) for i in range(600) if i != q)[:10]
        assert [h[1] for h in sorted(hits)] == [i for _, i in want]
        assert np.allclose([h[2] for h in sorted(hits)], [-v for v, _ in want])
    assert nearest.nearest(table.limit(0), F.lit(True), 10).count() == 0


def test_repeats(docs_of, corpus):
    rows = remove_repeats(docs_of(corpus), 50, 2_000).collect()
    texts = [(d, (t or "").encode()) for d, t, _ in corpus if d is not None]
    first = {}
    for d, b in sorted(texts):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], d)
    want = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[(d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want
    assert remove_repeats(docs_of([])).count() == 0


def test_media(docs_of, corpus, tmp_path):
    rows = media.media_columns(docs_of(corpus), str(tmp_path), 4_000).collect()
    texts = {d: (t or "").encode() for d, t, _ in corpus if d is not None}
    assert len(rows) == len([d for d, _, _ in corpus if d is not None])
    for r in rows:
        p = media.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        with open(r["shard"], "rb") as f:
            f.seek(r["place"])
            stored = f.read(r["media_bytes"])
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and media.decode_image(stored) == p and r["height"] * 64 == len(p)
    assert media.media_columns(docs_of([]), str(tmp_path)).count() == 0


def test_mix(docs_of, corpus):
    docs = docs_of(corpus)
    rows = mix(docs).collect()
    sizes = Counter()
    for d, t, s in corpus:
        if d is not None:
            sizes[s] += len(WORD.findall(t or ""))
    total, weights = 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2, 3)))
    full = set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = rest / sum(weights[s] for s in weights if s not in full)
        over = {s for s in weights if s not in full and share * weights[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    targets = {sizes[s]: 2 * sizes[s] if s in full else share * weights[s] for s in sizes}
    for size in targets:
        own = [r for r in rows if r["source_size"] == size]
        assert own[0]["target"] == pytest.approx(targets[size]) and sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(3)).collect()))
    assert mix(docs_of([])).count() == 0


@pytest.mark.parametrize("large", [4_000, 3])
def test_jaccard(docs_of, corpus, large):
    rows = jaccard_components(docs_of(corpus), large).collect()
    sets = []
    for d, t, _ in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}))
    sets = [s for s in sets if s[0] is not None]
    label = {d: d for d, _ in sets}
    for _ in sets:
        for d, a in sets:
            for e, b in sets:
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    label[d] = label[e] = min(label[d], label[e])
    assert sorted(map(tuple, rows)) == sorted((d, len(a), label[d]) for d, a in sets)
    assert jaccard_components(docs_of([])).count() == 0


def test_urls(spark):
    page = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.com/de/1", page.format("https://b.example.net/x")), (2, "http://www.b.example.net/x/?utm_source=q#t", ""), (3, "https://A.example.com/fr/1", page.format("http://b.example.net/x")),
        (4, None, None), (5, "no scheme", ""), (6, "https://example.org/en/12", ""), (7, "https://notexample.org/en/1", ""), (8, "https://x.example.net", ""), (8, "https://x.example.net", ""),
    ]
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter([
        (1, "a.example.com", "/de/1", "com/de/", "block"), (2, "www.b.example.net", "/x/", None, "block"), (3, "a.example.com", "/fr/1", "com/fr/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "example.org", "/en/12", "example.org/en/1", "block"), (7, "notexample.org", "/en/1", "org/", "allow"), (8, "x.example.net", "", None, "allow"), (8, "x.example.net", "", None, "allow"),
    ])


def test_lines(docs_of):
    line = prose(5, 40)
    fuzzy = line[:100] + "#" + line[101:]
    rows = [(1, f"{line}\nshort\n{prose(6, 30)}"), (2, f"short\n{fuzzy}\n{line}"), (3, None), (4, ""), (5, f"{prose(7, 30)}\n{prose(6, 30)}"), (None, line), (6, prose(8, 3000))]
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["size"]) for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {(1, rows[0][1], 3, 0, "x"), (2, "short", 3, 2, "x"), (3, None, 0, 0, "x"), (4, "", 1, 0, "x"), (5, prose(7, 30), 2, 1, "x"), (None, line, 1, 0, "x"), (6, rows[6][1], 1, 0, "x")}
    assert dedup_lines(docs_of([])).count() == 0


def test_quality(spark, docs_of):
    good, bad = [(k, prose(k, 80)) for k in range(60)], [(100 + k, " ".join(w + "%%%" for w in prose(k, 80).split())) for k in range(60)]
    docs = docs_of([*good, *bad, (300, None), (301, ""), (None, "x")])
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in good + bad if k % 4], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in score(docs, train(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == (k < 100) for k, _ in good + bad) and got[300] == got[301] and 0 <= got[300] <= 1 and len(got) == 122
    none = train(docs, labels.limit(0))
    assert {r["score"] for r in score(docs, none).collect()} == {0.5} and score(docs_of([]), none).count() == 0


def test_licenses(docs_of):
    notice = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    rows = [(1, "Text here.\nReleased under the MIT License."), (2, notice), (3, None), (4, "the mit license"), (5, "ALL RIGHTS RESERVED! " * 3), (None, "x")]
    got = {r["doc_id"]: (r["sequence"], r["licenses"]) for r in licenses.scan_licenses(docs_of(rows)).collect()}
    assert got == {1: ([1], ["MIT"]), 2: ([7, 8], []), 3: ([], []), 4: ([], []), 5: ([22, 22, 22], ["all-rights-reserved"])}
    assert licenses.scan_licenses(docs_of([])).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
def test_twins_and_pipeline(spark):
    import duckdb

    import corpus_pipeline
    from tessera.llm.oracles import ORACLES
    from tessera.llm.queries import QUERIES
    from tools.check import TABLES, rows_of

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df, cursor = QUERIES[name](spark, SF), db.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall()), name
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def similar_lines(lines: list[str]) -> dict[str, str]:
    """The first line that links reach, by comparing all sets of 8-character shingles."""
    sets = [{t[k : k + 8] for k in range(len(t) - 7)} for t in lines]
    first = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if first[i] != first[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if f == old else f for f in first]
    return {t: lines[f] for t, f in zip(lines, first)}


def kept_lines(docs_of, lines: list[str]) -> list[str]:
    rows = dedup_lines(docs_of(list(enumerate(lines)))).where("n_removed = 0").orderBy("doc_id").collect()
    return [r["text"] for r in rows]


def test_lines_of_a_template(docs_of):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    shared, lines = " ".join(word() for _ in range(34)), []
    for k in range(240):
        own = [word() for _ in range(6)]
        lines.append(" ".join([*own[:3], shared, *own[3:]]))
        if k % 3 == 0:
            lines.append(" ".join([*own[:3], shared, *own[3:5], word()]))
    r.shuffle(lines)
    first = similar_lines(lines)
    assert len(set(first.values())) == 240
    assert kept_lines(docs_of, lines) == [t for t in lines if first[t] == t]


def test_lines_without_spaces(docs_of):
    r = random.Random(4)
    lines = []
    for low, high in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E), (0x30, 0x5A)):
        base = "".join(chr(r.randint(low, high)) for _ in range(300))
        lines += [base, "X" + base, base[:150] + "Y" + base[150:], "".join(chr(r.randint(low, high)) for _ in range(300))]
    lines += ["\t".join(str(k * k) for k in range(60)), "a\t" + "\t".join(str(k * k) for k in range(60))]
    first = similar_lines(lines)
    assert kept_lines(docs_of, lines) == [t for t in lines if first[t] == t] and len(set(first.values())) == 9


NOTICES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_licence_notices_wrapped_or_not(docs_of):
    import textwrap

    rows, want = [], {}
    for name, text in NOTICES.items():
        text = text.replace("LICENSE-2.0 ", "LICENSE-2.0\n\n")
        wrapped = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, 70), ""]]
        for form in (text, "\n".join(wrapped), "\n".join("# " + x for x in wrapped), "/*\n" + "\r\n".join(" * " + x for x in wrapped) + "\n */"):
            rows.append((len(rows), "Some text\n\n" + form + "\nmore text"))
            want[rows[-1][0]] = [name]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs_of(rows)).collect()}
    assert got == want


def test_near_copies_of_the_pipeline(spark, docs_of):
    import corpus_pipeline

    rows = [(k, prose(200 + k, 150)) for k in range(8)]
    for k, changes in enumerate((1, 2, 3, 4, 5, 7, 9, 12)):
        w = rows[k][1].split(" ")
        for c in range(changes):
            w[8 + 11 * c] = f"changed{c}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, rows[0][1]), (301, ""), (302, None), (303, "one two"), (304, "one two"), (304, "one two")]
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").lower())) else set() for d, t in rows}
    likeness = {(d, e): len(a & b) / len(a | b) for d, a in sets.items() for e, b in sets.items() if d < e and a and b}
    assert any(0.8 <= x < 0.9 for x in likeness.values()) and any(0.5 < x < 0.8 for x in likeness.values())
    label = {d: d for d in sets}
    for _ in range(3):
        for (d, e), x in likeness.items():
            if x >= 0.8:
                label[d] = label[e] = min(label[d], label[e])
    kept = [r["doc_id"] for r in corpus_pipeline.unique_documents(spark, docs_of(rows), "").collect()]
    assert sorted(kept) == sorted(d for d in sets if label[d] == d)


def test_links_to_blocked_addresses_without_a_row(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.net/1", link.format("https://example.org/es/x")), (2, "https://a.example.net/2", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=https://www.example.org/es/y">'),
        (3, "https://b.example.com/new/3", "<LINK REL=Canonical HREF='/de/3'>"), (4, "https://b.example.com/new/4", link.format("../de/./4")), (5, "https://b.example.com/new/5", link.format("//c.example.com/de/5")),
        (6, "https://a.example.net/6", link.format("https://a.example.net/q?a=1&amp;b=2")), (7, "https://a.example.net/q?b=2&a=1", link.format("https://example.org/es/z")),
        (8, "https://b.example.com/fr/8", link.format("/de/8")), (9, "https://a.example.net/9", link.format("10")), (10, None, link.format("/de/10")), (11, "https://a.example.net/11", link.format("mailto:x@example.org")),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" if k <= 7 else "allow" for k in range(1, 12)}
