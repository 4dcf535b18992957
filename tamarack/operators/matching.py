"""Witnesses of containment and the three-valued consistency verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import title_case
from tamarack.operators.containment import containing  # noqa: F401

def first_witness(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, rank, phrase) of the first candidate, by rank, whose text has a phrase of the query, and the least such phrase.

    candidates: query_id, rank, text; phrases: query_id, phrase.
    """
    c = candidates.withColumn("_text", F.lower("text"))
    p = phrases.select("query_id", F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct()
    hits = c.join(p, "query_id").filter(F.contains("_text", "phrase"))
    return hits.groupBy("query_id").agg(F.min(F.struct("rank", "phrase")).alias("w")).select("query_id", "w.rank", "w.phrase")


def phrase_set(hits: DataFrame, by: str = "query_id", phrases: str = "symptoms") -> DataFrame:
    """Distinct lowered phrases of all hits of a query."""
    return hits.select(by, F.explode(phrases).alias("phrase")).select(by, F.lower("phrase").alias("phrase")).distinct()


def verdicts(requests: DataFrame, conditions: DataFrame, candidates: DataFrame, details: DataFrame) -> DataFrame:
    """(query_id, is_mismatch, explanation) of each request.

    requests: query_id, ocr_text. conditions: query_id, rank, disease, symptoms. candidates:
    query_id, rank, drug_name, the drugs found for the OCR text. details: query_id, rank,
    indications, what is known of a candidate (missing, null or empty: nothing). The first of
    these that applies decides: no OCR text, no condition, no candidate (each null); a candidate's
    indications have a symptom (false); no candidate has a name (null); otherwise true, also if
    nothing is known of any candidate.
    """
    named = candidates.filter(F.coalesce(F.col("drug_name"), F.lit("")) != "")
    texts = named.join(details, ["query_id", "rank"]).filter(F.coalesce(F.col("indications"), F.lit("")) != "").select("query_id", "rank", "drug_name", F.col("indications").alias("text"))
    found = first_witness(texts, phrase_set(conditions)).join(named, ["query_id", "rank"]).select("query_id", F.col("drug_name").alias("hit"), "phrase")
    top = conditions.groupBy("query_id").agg(F.min_by(F.struct(F.coalesce("disease", F.lit("the user's condition")).alias("d")), "rank")["d"].alias("disease"))
    some = candidates.groupBy("query_id").agg(F.lit(True).alias("any_candidate"), F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col("drug_name"), F.lit("")) != "", F.struct("rank", "drug_name")))), lambda x: x["drug_name"]).alias("names"))
    r = requests.select("query_id", "ocr_text").join(top, "query_id", "left").join(some, "query_id", "left").join(found, "query_id", "left")
    # fixed values: the sentences of the verdict
    cases = [
        (F.coalesce(F.col("ocr_text"), F.lit("")) == "", None, F.lit("No image provided; mismatch check is not applicable.")),
        (F.col("disease").isNull(), None, F.lit("Could not determine a likely condition; mismatch check is inconclusive.")),
        (F.col("any_candidate").isNull(), None, F.lit("Could not identify any potential drugs from the image; mismatch check is inconclusive.")),
        (F.col("hit").isNotNull(), False, F.format_string("The medicine appears appropriate. It contains '%s', which is used for symptoms like '%s', consistent with the user's likely condition.", title_case(F.col("hit")), F.col("phrase"))),
        (F.size("names") == 0, None, F.lit("Could not find detailed information for any drug identified in the image; mismatch check is inconclusive.")),
        (F.lit(True), True, F.format_string("Mismatch Detected: The active ingredients from the image (e.g., '%s') do not appear to treat the symptoms of the user's likely condition ('%s').", F.array_join("names", ", "), title_case(F.col("disease")))),
    ]
    pick = lambda i: F.coalesce(*[F.when(c[0], F.struct(F.lit(c[1]).cast("boolean").alias("v"), c[2].alias("t"))) for c in cases])[i]
    return r.select("query_id", pick("v").alias("is_mismatch"), pick("t").alias("explanation"))
