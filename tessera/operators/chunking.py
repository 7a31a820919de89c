"""Sources to chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ChunkRules
from tessera.functions.jsonwalk import json_lines
from tessera.functions.text import non_blank_lines, numbered_id, strip
from tessera.operators.numbering import running_start
from tessera.operators.unnest import unnest

CHUNK_COLUMNS = ["chunk_id", "order", "section", "text"]


def json_documents(sources: DataFrame, column: str = "json") -> DataFrame:
    """Adds `text` (one line per leaf) and source type 'json'; drops the JSON column."""
    lines = json_lines(F.col(column))
    return (
        sources.withColumn("text", F.array_join(lines, "\n"))
        .withColumn("source_type", F.lit("json"))
        .drop(column)
    )


def record_text(hall: Callable[[str], Column] = F.col) -> Column:
    """Labelled description of a nested hall record; missing fields give no line."""

    def labelled(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    def listed(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, "; ")))

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    def room(r: Column) -> Column:
        price = F.get(r["prices"], F.lit(0))
        cost = F.concat(
            F.lit(", £"),
            shown(price["per_week_gbp"]),
            F.lit(" per week (£"),
            shown(price["total_contract_gbp"]),
            F.lit(" total)"),
        )
        return F.concat(
            F.lit("Room type: "),
            shown(r["name"]),
            F.lit(", "),
            F.when(r["ensuite"], "en-suite").otherwise("shared bathroom"),
            F.lit(", "),
            shown(r["occupancy"]),
            F.lit(" occupancy, "),
            shown(r["tenancy_weeks"]),
            F.lit(" weeks tenancy"),
            F.when(F.size(r["prices"]) > 0, cost).otherwise(""),
        )

    rooms = F.when(
        F.size(hall("room_types")) > 0, F.array_join(F.transform(hall("room_types"), room), "\n")
    )
    return F.concat_ws(
        "\n",
        labelled("Hall name: ", hall("name")),
        labelled("Type: ", hall("type")),
        labelled("Address: ", hall("address")),
        labelled("Description: ", hall("short_description")),
        labelled("Catering: ", F.replace(hall("catering_type"), F.lit("_"), F.lit(" "))),
        listed("Services: ", hall("services")),
        listed("Facilities: ", hall("facilities")),
        rooms,
    )


def qna_blocks(pairs: DataFrame) -> DataFrame:
    """Question/answer rows (source_id, pos, question, answer) to labelled `block` text.

    A pair without a question is dropped. The text of a whole source is the blocks in `pos`
    order with a separator line between them; only the blocks are ever needed, so it is never
    put together.
    """
    question = strip(F.coalesce(F.col("question"), F.lit("")))
    answer = strip(F.coalesce(F.col("answer"), F.lit("")))
    block = F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)
    return pairs.filter(question != "").withColumn("block", block).drop("question", "answer")


def separated(text: Column, separator: str) -> Column:
    """Non-blank trimmed pieces between separators."""
    pieces = F.transform(F.split(text, r"\Q" + separator + r"\E"), strip)
    return F.filter(pieces, lambda p: p != "")


def qna_chunks(blocks: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Blocks to chunks numbered densely per source, in `pos` order."""
    pieces = blocks.withColumn("_pieces", separated(F.col("block"), rules.separator)).withColumn(
        "_n", F.size("_pieces")
    )
    placed = running_start(pieces, "source_id", "pos", "_n", "_first").drop("_n", "block")
    keep = [c for c in placed.columns if c not in ("_pieces", "_first", "pos")]
    rows = unnest(placed, [*keep, "_first"], F.col("_pieces"), "text", "_i")
    return _finish(
        rows.withColumn("order", F.col("_first") + F.col("_i"))
        .withColumn("section", F.lit("qna"))
        .drop("_first", "_i"),
        rules,
    )


def line_windows(lines: Column, size: Column) -> Column:
    """Fixed-size windows of an array of lines, each joined to one text."""
    starts = F.sequence(F.lit(0), (F.size(lines) - 1).cast("int"), size)
    windows = F.transform(starts, lambda at: F.array_join(F.slice(lines, at + 1, size), "\n"))
    return F.when(F.size(lines) > 0, windows)


def chunk_documents(docs: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Documents (source_id, source_type, text, ...) to chunks without a shuffle.

    `web` text is split at the separator, `json` and other text in windows of lines.
    """
    web = F.col("source_type") == "web"
    is_json = F.col("source_type") == "json"
    size = F.when(is_json, rules.json_lines).otherwise(rules.text_lines)
    prepared = docs.withColumn(
        "_parts",
        F.when(web, separated(F.col("text"), rules.separator)).otherwise(non_blank_lines(F.col("text"))),
    ).drop("text")
    pieces = F.when(web, F.col("_parts")).otherwise(line_windows(F.col("_parts"), size))
    keep = [c for c in prepared.columns if c != "_parts"]
    section = F.when(web, "qna").when(is_json, "json_fields").otherwise("text")
    rows = unnest(prepared, [*keep, section.alias("section")], pieces, "text", "order")
    return _finish(rows, rules)


def custom_chunks(docs: DataFrame, segment: Callable, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Documents to chunks with a user function text -> list of (section, text).

    The function runs on Arrow batches of documents, one document at a time.
    """
    @F.pandas_udf("array<struct<section:string,text:string>>")
    def pieces(texts: pd.Series, source_ids: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"section": s, "text": t} for s, t in segment(text, source_id, kind)]
                for text, source_id, kind in zip(texts, source_ids, types)
            ]
        )

    keep = [c for c in docs.columns if c != "text"]
    found = unnest(docs, keep, pieces("text", "source_id", "source_type"), "_piece", "order")
    rows = found.select(*keep, "order", F.col("_piece.section"), F.col("_piece.text"))
    return _finish(rows, rules)


def _finish(rows: DataFrame, rules: ChunkRules) -> DataFrame:
    return rows.withColumn(
        "chunk_id", numbered_id(F.col("source_id"), F.col("order"), F.col("text"), rules.id_prefix)
    )
