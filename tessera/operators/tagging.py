"""Domain, entities and key fields of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions.arrays import dedupe_ci, let, map_union, no_strings
from tessera.functions.modeljson import answer_fields, coerce_tags
from tessera.functions.text import capitalised_phrases, contains_any, split_lines, split_path_value, strip


def rule_domain(source_id: Column, text: Column, rules: C.DomainRules = C.DomainRules()) -> Column:
    """First matching keyword rule, source rules before text rules; null when none matches."""

    def first(ordered, value: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for words, domain in reversed(ordered):
            chosen = F.when(contains_any(value, words), domain).otherwise(chosen)
        return chosen

    return F.coalesce(
        first(rules.source, F.lower(source_id)), let(F.lower(text), lambda low: first(rules.text, low))
    )


def path_values(text: Column) -> Column:
    """Values of `path: value` lines whose path mentions a name-like marker."""
    pairs = F.transform(
        F.filter(split_lines(text), lambda line: F.contains(line, F.lit(":"))), split_path_value
    )
    named = F.filter(
        pairs, lambda p: contains_any(F.lower(p["path"]), C.ENTITY_MARKERS) & (p["value"] != "")
    )
    values = F.transform(named, lambda p: p["value"])
    # Most prose has no colon at all and need not be split.
    return F.when(F.contains(text, F.lit(":")), values).otherwise(no_strings())


def entities(text: Column, limit: int = C.MAX_TAGS) -> Column:
    """Named values, then capitalised phrases, de-duplicated without regard to case."""
    return dedupe_ci(F.concat(path_values(text), capitalised_phrases(text)), limit)


def key_fields(text: Column) -> Column:
    """Struct of content flags and samples; absent samples are null."""

    def flags(low: Column) -> Column:
        return F.struct(
            contains_any(low, C.PRICE_MARKERS).alias("price"),
            contains_any(low, C.ENTRY_MARKERS).alias("entry"),
            contains_any(low, C.LOCATION_MARKERS).alias("location"),
            (contains_any(low, ("question",)) & contains_any(low, ("answer",))).alias("qna"),
        )

    def samples(lines: Column) -> Column:
        prices = F.filter(lines, lambda x: contains_any(x, C.PRICE_LINE_MARKERS))
        named = F.filter(lines, lambda x: F.contains(x, F.lit(C.NAME_LINE_MARKER)))
        return F.struct(
            F.transform(F.slice(prices, 1, C.MAX_PRICE_LINES), strip).alias("prices"),
            split_path_value(F.get(named, F.lit(0)))["value"].alias("name"),
        )

    def joined(s: Column) -> Column:
        f, x = s["flags"], s["samples"]
        return F.struct(
            f["price"].alias("contains_price"),
            f["entry"].alias("contains_entry_requirements"),
            f["location"].alias("contains_location"),
            f["qna"].alias("contains_question_answer"),
            F.when(F.size(x["prices"]) > 0, x["prices"]).alias("sample_price_lines"),
            x["name"].alias("sample_name"),
        )

    sampled = contains_any(text, (*C.PRICE_LINE_MARKERS, C.NAME_LINE_MARKER))
    found = F.struct(
        let(F.lower(text), flags).alias("flags"),
        F.when(sampled, let(split_lines(text), samples)).alias("samples"),
    )
    return let(found, joined)


def with_rule_tags(chunks: DataFrame, rules: C.DomainRules = C.DomainRules()) -> DataFrame:
    """Adds hint_domain, domain, entity_tags, key_fields, extra and confidence from rules alone."""
    text = F.col("text")
    return (
        chunks.withColumn("hint_domain", rule_domain(F.col("source_id"), text, rules))
        .withColumn("domain", F.coalesce("hint_domain", F.lit(C.UNKNOWN_DOMAIN)))
        .withColumn("entity_tags", entities(text))
        .withColumn("key_fields", key_fields(text))
        .withColumn("extra", F.expr("cast(map() as map<string,string>)"))
        .withColumn("confidence", F.lit(C.HEURISTIC_CONFIDENCE))
    )


def merge_model_tags(
    tagged: DataFrame,
    answer: str,
    default_confidence: float = C.MODEL_CONFIDENCE,
    allowed=C.DOMAINS,
) -> DataFrame:
    """Overlay a model's answer on rule tags; rows whose answer is null keep the rule tags."""
    found = F.when(F.col(answer).isNotNull(), answer_fields(F.col(answer)))
    model = coerce_tags(F.col("_found"), F.col("hint_domain"), default_confidence, allowed)
    answered = F.col(answer).isNotNull()
    m = F.col("_model")
    return (
        tagged.withColumn("_found", found)
        .withColumn("_model", model)
        .withColumn("domain", F.when(answered & (m["domain"] != ""), m["domain"]).otherwise(F.col("domain")))
        .withColumn(
            "entity_tags",
            F.when(answered & (F.size(m["entity_tags"]) > 0), m["entity_tags"]).otherwise(
                F.col("entity_tags")
            ),
        )
        .withColumn(
            "extra",
            F.when(answered, map_union(F.col("extra"), m["key_fields"])).otherwise(F.col("extra")),
        )
        .withColumn(
            "confidence",
            F.when(answered, F.greatest("confidence", m["confidence"])).otherwise(F.col("confidence")),
        )
        .drop("_found", "_model", answer)
    )


TAG_TASK = "Label the chunk for search. Reply with one JSON object of these fields and nothing else."
# Labels that a tagging model is given: fixed values.
TAG_LABELS = (("Source ID: ", "source_id"), ("Source type: ", "source_type"), ("Hint domain: ", "hint_domain"))


def tag_contract(allowed=C.DOMAINS) -> dict[str, str]:
    """The fields of a tagging model's answer, as `merge_model_tags` reads them."""
    return {
        "domain": "one of: " + ", ".join(allowed),
        "entity_tags": f"a list of up to {C.MAX_TAGS} names found in the chunk",
        "key_fields": "an object of facts worth searching for, by name",
        "confidence": "a number from 0 to 1",
    }


def tag_prompts(chunks: DataFrame, task: str = TAG_TASK, allowed=C.DOMAINS) -> DataFrame:
    """For a tagging model: `system_prompt` (the task and the answer's fields) and `prompt` (the chunk, with its whole text)."""
    system = "\n".join([task, *(f"- {name}: {says}" for name, says in tag_contract(allowed).items())])
    labels = [F.concat(F.lit(label), F.coalesce(F.col(name), F.lit("unknown"))) for label, name in TAG_LABELS]
    prompt = F.concat(F.concat_ws("\n", *labels), F.lit("\n\nChunk:\n"), F.col("text"))
    return chunks.withColumns({"system_prompt": F.lit(system), "prompt": prompt})


def key_field_map(fields: Column, extra: Column) -> Column:
    """Rule fields and model fields as one map of texts; model values win."""
    named = F.from_json(F.to_json(fields), "map<string,string>")
    return map_union(named, extra)
