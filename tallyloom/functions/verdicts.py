"""Expressions over judge output and remote result payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import strip

# Spellings that count as a verdict in the distribution chart.
CORRECT_SPELLINGS = ("correct", "Correct", "true", "1")
INCORRECT_SPELLINGS = ("incorrect", "Incorrect", "false", "0")

# Names and defaults of the judge's own fields.
VERDICT_FIELDS = ("total_rating", "correctness", "reasoning")
NO_CONTENT = "NOCONTENT"

PAYLOAD_SCHEMA = (
    "outputs array<struct<outputs: array<struct<results: "
    "struct<message: struct<result: string>>>>>>"
)


def verdict_map(text: Column) -> Column:
    """All fields of a verdict object as text; NULL when it is no JSON object."""
    return F.from_json(text, "map<string,string>")


def verdict_field(fields: Column, name: str, default: str) -> Column:
    """One verdict field; the default stands in only where the key is absent."""
    return F.when(F.map_contains_key(fields, name), fields[name])\
        .when(fields.isNotNull(), F.lit(default))


def verdict_extras(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*VERDICT_FIELDS))


def normalise_correctness(value: Column) -> Column:
    return (
        F.when(value.isin(*CORRECT_SPELLINGS), F.lit("Correct"))
        .when(value.isin(*INCORRECT_SPELLINGS), F.lit("Incorrect"))
        .otherwise(F.lit("Unknown"))
    )


def quality_band(error_rate: Column) -> Column:
    return (
        F.when(error_rate < 5, F.lit("excellent"))
        .when(error_rate < 15, F.lit("good"))
        .otherwise(F.lit("moderate"))
    )


def _unfence(part: Column) -> Column:
    """Drop a code fence around one output part."""
    part = strip(part)
    part = F.when(part.startswith("```"), strip(F.regexp_replace(part, r"^[^\n]*\n?", "")))\
        .otherwise(part)
    return F.when(part.endswith("```"), strip(F.regexp_replace(part, r"```\z", "")))\
        .otherwise(part)


def extract_output(payload: Column) -> Column:
    """Text of a finished result payload; ``NOCONTENT`` when it holds none.

    NULL where the payload is not of the expected shape.
    """
    parts = F.get(F.from_json(payload, PAYLOAD_SCHEMA)["outputs"], F.lit(0))["outputs"]
    texts = F.transform(parts, lambda p: _unfence(p["results"]["message"]["result"]))
    joined = strip(F.array_join(texts, "\n"))
    return F.when(joined == "", F.lit(NO_CONTENT)).otherwise(joined)
