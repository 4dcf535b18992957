"""The retrieval pipelines over a table of requests: search, check, prompt, answer, card.

Every step is a plan over all requests at once. requests: query_id, user_text, ocr_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.jsonx import extract_object
from tamarack.functions.text import join_sources, strip
from tamarack.lineage import cut
from tamarack.operators import cards, matching, models
from tamarack.operators.knn import Asked, asked
from tamarack.operators.spelling import normalize
from tamarack.sources.catalog import Catalog

USER_K, CHECKED_K, CANDIDATES = 5, 3, 3


def _asked(texts: DataFrame, dictionary: DataFrame | None, embedder) -> Asked:
    """The queries of texts (query_id, side, text), by side, run once: each distinct text is normalised and embedded once."""
    known = texts.withColumn("text", F.coalesce("text", F.lit("")))
    plain = normalize(known.select("text").distinct().withColumn("id", F.col("text")), dictionary).withColumnRenamed("id", "text")
    embedded = known.join(models.embed_texts(plain, "normalized", "query", embedder), "text")
    return asked(embedded.select(F.struct("side", F.col("query_id").alias("id")).alias("query_id"), "query", "side"), ["side"])


def _sides(requests: DataFrame, **columns: Column) -> DataFrame:
    """(query_id, side, text) of each request and side whose text isn't null."""
    each = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), text.alias("text")) for side, text in columns.items()]))
    return requests.select("query_id", each.alias("x")).select("query_id", "x.side", "x.text").filter("text is not null")


def _of(hits: DataFrame, side: str, source: str | None = None) -> DataFrame:
    """The hits of one side's queries, with their source if it is given."""
    own = hits.filter(F.col("query_id.side") == side).withColumn("query_id", F.col("query_id.id"))
    return own if source is None else own.select("query_id", F.lit(source).alias("source"), "rank", "key", "score", "rec", F.col("rec").alias("obj"))


def run(requests: DataFrame, catalog: Catalog, dictionary: DataFrame | None = None, k: int = USER_K, embedder=models.stub_embedder, generator=models.stub_generator) -> DataFrame:
    """(query_id, prompt, result) of each request, without the mismatch check.

    The user text is searched in diseases and drugs, the OCR text, where there is any, in
    drug_dict and drugs. Queries are embedded once, each index is searched once, each prompt is answered once.
    """
    seen = requests.filter(F.coalesce("ocr_text", F.lit("")) != "")
    all_ = _asked(_sides(requests, user=F.coalesce("user_text", F.lit("")), ocr=F.nullif("ocr_text", F.lit(""))), dictionary, embedder)
    drugs = catalog.search("drugs", all_, k)
    by_user = _of(catalog.search("diseases", all_.only("side", "user"), k), "user", "diseases").union(_of(drugs, "user", "drugs"))
    by_ocr = _of(catalog.search("drug_dict", all_.only("side", "ocr"), k), "ocr", "drug_dict").union(_of(drugs, "ocr", "drugs_from_ocr"))
    user_context = cards.retrieval_context(requests, ["diseases", "drugs"], by_user).withColumnRenamed("context", "user_context")
    ocr_context = cards.retrieval_context(seen, ["drug_dict", "drugs_from_ocr"], by_ocr).withColumnRenamed("context", "ocr_context")
    joined = requests.join(user_context, "query_id").join(ocr_context, "query_id", "left")
    prompt = cards.analysis_prompt(F.col("user_text"), F.col("ocr_text"), F.col("user_context"), F.coalesce("ocr_context", F.lit("")))
    answered = cut(models.generate(joined.select("query_id", "user_text", "ocr_text", prompt.alias("prompt")), factory=generator))
    done = answered.withColumn("llm_output", strip(F.coalesce("reply.text", F.concat(F.lit("Error: "), "reply.error"))))
    made = cards.summary_cards(done.select("query_id", "user_text", "ocr_text", "llm_output"), cards.merge_retrievals(by_user, by_ocr), ["diseases", "drugs", "drug_dict", "drugs_from_ocr"])
    return done.select("query_id", "prompt").join(made, "query_id").select("query_id", "prompt", cards.result(F.col("card")).alias("result"))


def check(requests: DataFrame, conditions: DataFrame, found: DataFrame, catalog: Catalog, dictionary: DataFrame | None = None, embedder=models.stub_embedder) -> DataFrame:
    """(query_id, is_mismatch, explanation); conditions: hits of the user text in diseases, found: those of the OCR text in drug_dict."""
    chunk = "from_json(get_json_object(rec, '$.chunk'), 'disease string, symptoms array<string>')"
    likely = conditions.select("query_id", "rank", F.expr(f"{chunk}.disease").alias("disease"), F.expr(f"coalesce({chunk}.symptoms, array())").alias("symptoms"))
    found = found.select("query_id", "rank", F.get_json_object("rec", "$.drug_name").alias("drug_name"))
    names = found.filter(F.coalesce("drug_name", F.lit("")) != "").select(F.col("drug_name").alias("query_id")).distinct()
    best = catalog.search("drugs", _asked(_sides(names, name=F.col("query_id")), dictionary, embedder), 1)
    details = _of(best, "name").select(F.col("query_id").alias("drug_name"), F.get_json_object("rec", "$.indications_and_usage").alias("indications"))
    return matching.verdicts(requests, likely, found, found.join(details, "drug_name").select("query_id", "rank", "indications"))


def run_checked(requests: DataFrame, catalog: Catalog, dictionary: DataFrame | None = None, k: int = CHECKED_K, embedder=models.stub_embedder, generator=models.stub_generator) -> DataFrame:
    """(query_id, prompt, answer, result) with the verdict of check in the prompt and the result.

    Drugs are searched by user and OCR text together. The answer's JSON object is taken out of the
    reply; if there is none, it is the reply and an error.
    """
    all_ = _asked(_sides(requests, user=F.coalesce("user_text", F.lit("")), ocr=F.nullif("ocr_text", F.lit("")), both=join_sources(F.col("user_text"), F.col("ocr_text"))), dictionary, embedder)
    conditions = _of(catalog.search("diseases", all_.only("side", "user"), k), "user")
    names = catalog.search("drug_dict", all_.only("side", "ocr", "both"), max(k, CANDIDATES))
    hits = conditions.select("query_id", F.lit("diseases").alias("source"), "rank", "key", "score", "rec", F.col("rec").alias("obj"))
    hits = hits.union(_of(catalog.search("drugs", all_.only("side", "both"), k), "both", "drugs")).union(_of(names.filter(F.col("rank") <= k), "both", "drug_dict"))
    context = cards.retrieval_context(requests, ["diseases", "drugs", "drug_dict"], hits)
    verdicts = check(requests, conditions, _of(names.filter(F.col("rank") <= CANDIDATES), "ocr"), catalog, dictionary, embedder)
    judged = requests.join(verdicts, "query_id").join(context, "query_id")
    prompt = cards.structured_prompt(F.col("is_mismatch"), F.col("explanation"), F.coalesce("user_text", F.lit("")), F.col("ocr_text"), F.col("context"))
    replied = cut(models.generate(judged.withColumn("prompt", prompt), factory=generator)).withColumn("answer", extract_object(F.coalesce("reply.text", F.lit(""))))
    out = F.coalesce("answer.parsed", F.to_json(F.struct("answer.error", "answer.raw_text")))
    made = cards.summary_cards(replied.select("query_id", "user_text", "ocr_text", out.alias("llm_output")), hits, ["diseases", "drugs", "drug_dict"])
    kept = replied.select("query_id", "prompt", "answer", "is_mismatch", "explanation").join(made, "query_id")
    return kept.select("query_id", "prompt", "answer", cards.result(F.col("card"), F.col("is_mismatch"), F.col("explanation")).alias("result"))
