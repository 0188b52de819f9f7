"""Replies of models: salvage of JSON, validation, usage, prices, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .annotations import LABELS
from .text import strip

# Prices in dollars for a million tokens in and out.
EXTRACTION_PRICE = (3.00, 15.00)
LABELLING_PRICES = {"haiku": (1.00, 5.00), "gemini": (0.30, 2.50)}
# What a reply to each field group holds.
REPLY_SCHEMAS = {
    "condition_study_type": "conditions string, study_type string",
    "demographics": "sex string, minimum_age string, maximum_age string",
    "eligibility": "inclusion_criteria array<string>, exclusion_criteria array<string>",
}
ENUMS = {"study_type": ("INTERVENTIONAL", "OBSERVATIONAL"), "sex": ("MALE", "FEMALE", "ALL")}


def unfenced(text: Column) -> Column:
    """The reply without a code fence around it and without a leading ``json``."""
    body = strip(text)
    inside = strip(F.regexp_replace(F.regexp_replace(body, r"(?s)\A```[^\n]*(?:\n|\z)", ""), r"(?:\A|\n)[ \t]*```[ \t]*\z", ""))
    return F.when(body.startswith("```"), F.regexp_replace(inside, r"(?i)\Ajson\s*", "")).otherwise(body)


def salvage(text: Column, schema: str, thinking: bool = False) -> Column:
    """The struct of a free-form reply: the whole text as JSON, or its part from the first to the last brace; else null.

    ``thinking`` drops what stands between think tags, and code fences, first.
    """
    raw = strip(text)
    if thinking:
        raw = F.regexp_replace(strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")), r"```(?:json)?", "")
    raw = F.regexp_replace(F.regexp_replace(strip(raw), r"[\x00-\x08\x0B-\x1f\x7f]", ""), r"\n\s*", " ")
    part = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = F.when(raw.startswith("{") & raw.endswith("}"), raw).otherwise(part)
    found = F.from_json(F.nullif(whole, F.lit("")), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    fields = [name.strip().split()[0] for name in _split(schema)]
    return F.when(found["_bad"].isNull() & found.isNotNull(), F.struct(*[found[f].alias(f) for f in fields]))


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def label_reply(text: Column) -> tuple[Column, Column]:
    """(struct of label, overall_relevance, reason; error): one of the two is null."""
    body = unfenced(text)
    kind = F.get_json_object(body, "$")
    get = lambda key: F.get_json_object(body, f"$.{key}")
    raw = F.regexp_extract(body, r'"overall_relevance"\s*:\s*([^,}\s]+)', 1)
    error = (
        F.when(kind.isNull(), "not JSON")
        .when(~body.startswith("{"), "not an object")
        .when(~F.coalesce(get("label").isin(*LABELS), F.lit(False)), "invalid label")
        .when(~raw.rlike(r"^[1-5]$"), "invalid relevance")
        .when(strip(get("reason")) == "", "no reason")
    )
    good = F.struct(get("label").alias("label"), raw.try_cast("int").alias("overall_relevance"), strip(get("reason")).alias("reason"))
    return F.when(error.isNull(), good), error


def count_of(text: Column) -> Column:
    """A number of tokens or dollars from a cell of any kind; what is no number counts 0."""
    return F.coalesce(text.cast("string").try_cast("double"), F.lit(0.0))


def response_field(body: Column, path: str) -> Column:
    """A field of a response in JSON, null where the response or the field is missing."""
    return F.get_json_object(body, f"$.{path}")


def json_text(value: Column) -> Column:
    """A struct, map or array as JSON, null as the empty text."""
    return F.coalesce(F.to_json(value), F.lit(""))


def usage(body: Column) -> Column:
    """Input, output and reasoning tokens of a response in JSON, 0 where missing; reasoning from the details, else from the usage itself."""
    n = lambda path: F.coalesce(response_field(body, f"usage.{path}").try_cast("int"), F.lit(0))
    detailed = n("completion_tokens_details.reasoning_tokens")
    reasoning = F.when(detailed == 0, n("reasoning_tokens")).otherwise(detailed)
    return F.struct(n("prompt_tokens").alias("input_tokens"), n("completion_tokens").alias("output_tokens"), reasoning.alias("reasoning_tokens"))


def price(tokens_in: Column, tokens_out: Column, prices: tuple[float, float] = EXTRACTION_PRICE) -> Column:
    """Dollars for the tokens; nulls count 0."""
    zero = F.lit(0)
    return F.coalesce(tokens_in, zero) / F.lit(1e6) * F.lit(prices[0]) + F.coalesce(tokens_out, zero) / F.lit(1e6) * F.lit(prices[1])


def delay(attempt: int, jitter: float, capped_with_jitter: bool = True) -> float:
    """Seconds before the next attempt, doubling up to a minute; the jitter under the cap or on top of it."""
    wait = 2.0 ** (attempt - 1)
    return min(60.0, wait + jitter) if capped_with_jitter else min(60.0, wait) + jitter


def listed_answer(text: Column) -> Column:
    """A gold or model answer as a list: a written list in either kind of quotes, else the parts at commas; a broken list is one item."""
    body = strip(text)
    doubled = F.replace(F.regexp_replace(body, r"(?<=[\[,\s])'|'(?=\s*[,\]])", '"'), F.lit("\\'"), F.lit("'"))
    parsed = F.from_json(doubled, "array<string>")
    parts = F.filter(F.transform(F.split(body, ","), strip), lambda x: x != "")
    return F.when(body == "", F.array().cast("array<string>")).when(body.startswith("["), F.coalesce(parsed, F.array(body))).otherwise(parts)


def flat_answer(items: Column) -> Column:
    """A list as one string, at commas; null as empty."""
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def now_text() -> Column:
    """The current time in UTC, ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def response_format(field: str) -> dict:
    """The strict JSON schema of a field's reply, from ``REPLY_SCHEMAS`` and ``ENUMS``."""
    properties: dict[str, dict] = {}
    for part in _split(REPLY_SCHEMAS[field]):
        name, kind = part.split()
        properties[name] = {"type": "array", "items": {"type": "string"}} if kind.startswith("array") else {"type": "string"}
        if name in ENUMS:
            properties[name]["enum"] = list(ENUMS[name])
    schema = {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    return {"type": "json_schema", "json_schema": {"name": field, "strict": True, "schema": schema}}
