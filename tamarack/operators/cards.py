"""Retrieval contexts, prompts, summary cards and reports, as ordered aggregates over hits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.jsonx import strict
from tamarack.functions.text import fixed4, or_default, tri_state

#: Fields of a preview, in this order.
PREVIEW = ("disease", "symptoms", "brand_name", "generic_name", "drug_name", "indications_and_usage")
NO_IMAGE = "No image provided."
NOT_CHECKED = "Mismatch check not performed in this pipeline version."

#: The default prompt; its four slots are user_text, ocr_text, user_context and ocr_context.
ANALYSIS_PROMPT = """You compare a person's symptoms with a medicine read from its package. Use nothing but the data below.

Symptoms:
{user_text}

Text on the package:
{ocr_text}

Records found for the symptoms:
{user_context}
Records found for the package:
{ocr_context}
First say whether the medicine suits the symptoms and why. Then, under "### Suggested Alternatives", list active ingredients from the records found for the symptoms, each with one line on what it does. End with "### Important Warning" and the advice to ask a doctor or pharmacist. Add nothing else.
"""

#: The prompt for a structured answer; slots: verdict, explanation, context.
STRUCTURED_PROMPT = """Answer with one JSON object that has the fields likely_condition, medication_suggestions, dosage_information, self_care_tips, warnings and mismatch_analysis.
A check by rules came first: {explanation} In mismatch_analysis, set is_mismatch to {verdict} and explanation to that sentence.
{context}"""


def render(template: str, **slots: Column) -> Column:
    """template with each {slot} replaced once; values aren't searched for slots."""
    parts, at = [], 0
    for name, i in sorted(((n, template.index("{" + n + "}")) for n in slots), key=lambda x: x[1]):
        parts += [F.lit(template[at:i]), slots[name]]
        at = i + len(name) + 2
    return F.concat(*parts, F.lit(template[at:]))


def retrieval_context(requests: DataFrame, sources: list[str], hits: DataFrame) -> DataFrame:
    """(query_id, context): per source its header and its hits in rank order, or that there are none.

    hits: query_id, source, rank, score, obj (text).
    """
    line = F.concat(F.lit("* Result: "), "obj", F.lit(" (Score: "), fixed4(F.col("score")), F.lit(")\n"))
    lines = hits.groupBy("query_id", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    each = requests.select("query_id", F.posexplode(F.array(*map(F.lit, sources))).alias("at", "source")).join(lines, ["query_id", "source"], "left")
    part = F.concat(F.lit("\n-- Retrieved from "), F.upper("source"), F.lit(" --\n"), F.coalesce("body", F.lit("No results found.\n")))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda x: x["part"]), "").alias("context"))


def analysis_prompt(user_text: Column, ocr_text: Column, user_context: Column, ocr_context: Column, template: str = ANALYSIS_PROMPT) -> Column:
    return render(template, user_text=F.coalesce(user_text, F.lit("")), ocr_text=or_default(ocr_text, NO_IMAGE), user_context=user_context, ocr_context=ocr_context)


def structured_prompt(verdict: Column, explanation: Column, user_text: Column, ocr_text: Column, context: Column, template: str = STRUCTURED_PROMPT) -> Column:
    said = F.concat_ws("\n", F.lit("=== USER INPUT ==="), F.concat(F.lit("User text: "), user_text), F.when(F.coalesce(ocr_text, F.lit("")) != "", F.concat(F.lit("OCR: "), ocr_text)), F.lit("=== RETRIEVED DATA ==="), context)
    return render(template, verdict=tri_state(verdict), explanation=explanation, context=said)


def preview(rec: Column) -> Column:
    """MAP of the preview fields that a JSON record, or the chunk inside it, has."""
    data = F.coalesce(F.get_json_object(rec, "$.chunk"), rec)
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, PREVIEW)), F.array(*[F.get_json_object(data, f"$.{f}") for f in PREVIEW])), lambda _, v: v.isNotNull())


def hit_counts(hits: DataFrame) -> DataFrame:
    """(query_id, source, n) of the sources that have hits."""
    return hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))


def summary_cards(requests: DataFrame, hits: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(query_id, card) with user_text, ocr_text, llm_output and retrieved: source to [key, score, preview] in rank order.

    requests: query_id, user_text, ocr_text, llm_output. hits: query_id, source, rank, key, score,
    rec. Sources are in the order of ``sources``, in which they were searched; others follow by name.
    """
    place = F.when(F.col("source").isin(*sources), F.array_position(F.array(*map(F.lit, sources)), F.col("source"))) if sources else F.lit(None).cast("long")
    per = hits.groupBy("query_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "score", F.to_json(preview(F.col("rec"))).alias("preview")))), lambda x: F.struct(x["key"].alias("key"), x["score"].alias("score"), x["preview"].alias("preview"))).alias("items"))
    found = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(place, F.lit(1 << 30)).alias("at"), "source", "items"))).alias("r")).select("query_id", F.map_from_entries(F.transform("r", lambda x: F.struct(x["source"], x["items"]))).alias("retrieved"))
    none = F.expr("cast(map() as map<string, array<struct<key: string, score: double, preview: string>>>)")
    card = F.struct("user_text", "ocr_text", "llm_output", F.coalesce("retrieved", none).alias("retrieved"))
    return requests.join(found, "query_id", "left").select("query_id", card.alias("card"))


def result(card: Column, mismatch: Column | None = None, details: Column | None = None) -> Column:
    """struct(card, meta): without a verdict, the mismatch is null and not checked."""
    none = F.lit(None).cast("boolean")
    return F.struct(card.alias("card"), F.struct((none if mismatch is None else mismatch).alias("mismatch"), (F.lit(NOT_CHECKED) if details is None else details).alias("mismatch_details")).alias("meta"))


def indented(text: Column) -> Column:
    """JSON texts with two blanks for each level, non-ASCII escaped."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(json.loads(x), indent=2), na_action="ignore")

    return of(text)


def page(card: Column) -> Column:
    """What is shown of a card: the OCR text, where there is any, then the answer."""
    return F.concat_ws("\n\n", F.when(F.coalesce(card["ocr_text"], F.lit("")) != "", F.concat(F.lit("**OCR:** "), card["ocr_text"])), F.coalesce(card["llm_output"], F.lit("")))


def report(card: Column) -> Column:
    """A card as text; an llm_output that is a JSON object is indented, one with an error shows it and the raw text."""
    out = card["llm_output"]
    failed, object_ = F.get_json_object(out, "$.error"), out.rlike(r"^\s*\{") & strict(out).isNotNull()
    answer = F.when(failed.isNotNull(), F.concat(F.lit("Error: "), failed, F.lit("\nRaw Text: "), F.coalesce(F.get_json_object(out, "$.raw_text"), F.lit("")))).when(object_, indented(F.when(object_, out))).otherwise(F.coalesce(out, F.lit("")))
    items = lambda v: F.transform(v, lambda i: F.concat(F.lit(" - "), i["key"], F.lit(" (score: "), fixed4(i["score"]), F.lit(") preview: "), i["preview"]))
    listed = F.flatten(F.transform(F.map_entries(card["retrieved"]), lambda e: F.concat(F.array(F.concat(F.lit("["), e["key"], F.lit("]"))), items(e["value"]))))
    return F.concat_ws("\n", F.lit("=== Result ==="), F.when(F.coalesce(card["ocr_text"], F.lit("")) != "", F.concat(F.lit("OCR: "), card["ocr_text"])), F.concat(F.lit("User: "), card["user_text"]), F.lit("\n-- LLM RESPONSE --\n"), answer, F.lit("\n-- Retrieved (short) --\n"), listed)


def merge_retrievals(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of both; where both have a source for a query, the second's."""
    kept = first.join(second.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    return kept.unionByName(second.select(*kept.columns))
