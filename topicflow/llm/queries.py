"""The operators as queries over whole tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicflow.llm import decontaminate, jaccard, language, lines, merkle, mixing, quality, repeats, spelling, suffixes, token_counts, url_rules, warc
from topicflow.llm.common import table
from topicflow.session import lasting_dir, shared_dir

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"),
        lasting_dir(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def domains_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic, junk (low quality) or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")
    labels = table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id").select("text", "domain")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixing_rates(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        domains_of(spark, sf_dir),
        {"good": 0.95, "junk": 0.05, "toxic": 0.0},
        shared_dir(spark, "mixing"),
    )
    return mixed.drop("text")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit_profiles(docs.where(~held_out()))
    predicted = language.predict_language(docs, profiles)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.quality_ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality.passes("base")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), quality.passes().alias("kept"), "fail_bits",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixes.remove_later_copies(docs)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), shared_dir(spark, "jaccard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write_warc(warc.with_revisits(pages), shared_dir(spark, "warc"))
    return warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), shared_dir(spark, "spelling"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.without_repeated_lines(docs, lines.repeated_lines(docs, shared_dir(spark, "lines")))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proved = merkle.manifest(merkle.document_leaves(docs, tampered), shared_dir(spark, "merkle"))
    return proved.drop("copied").withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
