"""JSON in free text: object extraction, strict parsing, reply fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_span(s: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none after it."""
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when((first > 0) & (F.instr(s, "}") > 0) & (last > first), F.substring(s, first, last - first + 1))


def strict(s: Column) -> Column:
    """The variant of a text that is one JSON value; null otherwise.

    A parser that stops at the first value would take trailing text, so the value is parsed as
    the only element of an array.
    """
    held = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    return F.when(F.try_variant_get(held, "$[1]", "variant").isNull(), F.try_variant_get(held, "$[0]", "variant"))


def extract_object(s: Column) -> Column:
    """struct(parsed, raw_text, error): the object in s as JSON text, or s and why there is none."""
    span = object_span(s)
    ok = strict(span).isNotNull()
    return F.struct(F.when(ok, span).alias("parsed"), F.when(~F.coalesce(ok, F.lit(False)), s).alias("raw_text"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("Failed to parse LLM response as JSON.")).alias("error"))


def reply_text(s: Column) -> Column:
    """The text of a generation reply: response, text, output, results[0].content, the JSON itself, or s if it is none."""
    return F.coalesce(*[F.get_json_object(s, f"$.{p}") for p in ("response", "text", "output", "results[0].content")], s)
