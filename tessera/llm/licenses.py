"""Licence scans: known licence sentences, then rules over their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents_of

# Sentences of public licences and notices, as normalised by `normalised` below, and their numbers.
SENTENCES = {
    1: "released under the mit license",
    2: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    3: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    4: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    5: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    6: "licensed under the apache license version 2 0",
    7: "licensed under the apache license version 2 0 the license",
    8: "you may not use this file except in compliance with the license",
    9: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    10: "see the license for the specific language governing permissions and limitations under the license",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    14: "see the gnu general public license for more details",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    19: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    20: "this source code form is subject to the terms of the mozilla public license v 2 0",
    21: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    22: "all rights reserved",
}
# Rule name, licence, and the sentence numbers that must follow each other (other text may lie between).
RULES = (
    ("mit-notice", "MIT", (1,)),
    ("mit-text", "MIT", (2, 3, 4, 5)),
    ("apache-2.0-line", "Apache-2.0", (6,)),
    ("apache-2.0-notice", "Apache-2.0", (7, 8, 9, 10)),
    ("gpl-3.0-line", "GPL-3.0", (11,)),
    ("gpl-3.0-notice", "GPL-3.0", (12, 13, 14)),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", (15,)),
    ("cc-by-4.0-line", "CC-BY-4.0", (16,)),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", (17,)),
    ("bsd-text", "BSD", (18, 19)),
    ("mpl-2.0-notice", "MPL-2.0", (20, 21)),
    ("rights-reserved", "all-rights-reserved", (22,)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The pieces of a text in lower case, each between line feeds: they end at a line's end or at . ! ? ; : before white space."""
    ended = F.regexp_replace(text, r"[.!?;:]+([ \t\r\f]|\z)", "\n")
    plain = F.regexp_replace(F.translate(ended, UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), r" *\n[ \n]*", "\n")


def scan_licenses(docs: DataFrame, known: dict[int, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Licences of every document: `doc_id, n_sentences, sequence, rules, licenses`.

    `sequence` lists the numbers of the known sentences in text order; a rule fits where its numbers stand next to
    each other in it. `rules` and `licenses` are sorted and distinct. `n_sentences` counts the pieces of `normalised`.
    A known sentence is found where one piece or several in a row make it up, so line ends, comment signs and marks
    inside it (a wrapped notice, "free software: you can", "v. 2.0") do not matter; of those that begin at one place
    the longest counts. One pass per text with a pattern of the constant list, no join.

    A null or empty text has no sentence and empty lists. Rows of the same doc_id are read as one document's parts
    in no set order of rows; rows without a doc_id are left out, an empty table gives no rows, other columns are
    not read.
    """
    longest_first = sorted(known.values(), key=len, reverse=True)
    pattern = r"(?<=\n)(?:" + "|".join(v.replace(" ", "[ \n]") for v in longest_first) + r")(?=\n)"
    number = F.create_map(*[F.lit(x) for k, v in known.items() for x in (v, k)])
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = documents_of(docs).select("doc_id", normalised(F.col("text")).alias("plain"))
    rows = rows.withColumn("found", F.regexp_extract_all("plain", F.lit(pattern), F.lit(0)))
    # What stands before each hit ends in a line feed, so the line feeds up to a hit number its first piece.
    parts = F.when(F.size("found") > 0, F.split("plain", pattern, -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("ends", F.transform(F.arrays_zip("found", F.slice(parts, 1, F.size("found")).alias("before")), lambda x: F.struct(lines(x["before"]).alias("before"), lines(x["found"]).alias("inside"))))
    at = lambda i: F.aggregate(F.slice("ends", 1, i), F.lit(0), lambda n, x: n + x["before"] + x["inside"]) + F.get("ends", i)["before"]
    hit = lambda x, i: F.struct(at(i).alias("at"), F.element_at(number, F.translate(x, "\n", " ")).alias("number"))
    found = rows.select("doc_id", (lines(F.col("plain")) - 1).cast("long").alias("n"), F.transform("found", hit).alias("hits"))
    found = found.groupBy("doc_id").agg(F.sum("n").alias("n_sentences"), F.flatten(F.collect_list("hits")).alias("hits"))
    numbers = F.transform(F.array_sort("hits"), lambda x: x["number"])
    rows = docs.where("doc_id is not null").select("doc_id").distinct().join(found, "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce(numbers, F.array().cast("array<int>")).alias("sequence"))
    text = F.concat(F.lit(","), F.array_join(F.col("sequence").cast("array<string>"), ","), F.lit(","))
    fits = [(text.contains("," + ",".join(map(str, r)) + ","), name, licence) for name, licence, r in rules]
    named = lambda k: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(f[0], F.lit(f[k])) for f in fits]))))
    return rows.select("doc_id", "n_sentences", "sequence", named(1).alias("rules"), named(2).alias("licenses"))
