"""The queries opN_<name> over the test tables, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import capfilter, chat, collocations, decontam, exact_dedup, hardneg, langid, mixing, quality, secrets_scan, simhash, urlfilter, warc
from tamarack.llm._common import read, with_row


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, also with other numbers, units or names."""
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document, sources weighing 3, 1, 2 in turn."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose SimHash fingerprints link at 4 or fewer differing bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets, candidates told apart by how many sources have them."""
    return secrets_scan.find_secrets(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a network fitted on the rows that aren't held out."""
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as read back from WARC archives."""
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact_dedup.exact_duplicates(with_row(read(spark, sf_dir, "documents"))).drop("_tmk_row")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations, and of one with control strings, as read back from their windows."""
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -1L AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(chat.chat_windows(own.union(tricky)))


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of the documents."""
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the pages' urls, by rule or by the trust and distrust of their hosts."""
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by how much more often they occur than their parts would."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each positive of each anchor, in integer scores."""
    e = read(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    own = e.select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("z"), F.expr("vec_id % 50 = 0").alias("anchor"))
    return hardneg.hard_negatives(own)


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of the vectors whose cosine is 0.9 or more."""
    return capfilter.links(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_template_decontamination, op2_source_mix, op3_simhash, op4_secret_ownership, op5_language_id, op6_warc_round_trip, op7_exact_dedup, op8_chat_windows, op9_quality_qda, op10_url_trust, op11_collocations, op12_hard_negatives, op13_cap_filters)}

ORACLE_SQL: dict[str, str] = {"op7_exact_dedup": exact_dedup.ORACLE_SQL, "op8_chat_windows": chat.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_hard_negatives": hardneg.ORACLE_SQL, "op13_cap_filters": capfilter.ORACLE_SQL}
