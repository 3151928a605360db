"""The driver's parquet tables seen as papers, notes, decisions, questions and logs.

Every view covers its whole table. Years, venues and note shapes follow from ids
because the tables carry no such columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicflow.functions.text import normalise_nfkc, strip_to_ascii
from topicflow.session import spread
from topicflow.sources.notes import notes_from_json

FIRST_YEAR, YEARS = 2020, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_of(doc_id: Column) -> Column:
    return (F.lit(FIRST_YEAR) + F.floor(doc_id / 20) % YEARS).cast("int")


def _venue() -> Column:
    return F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, F.lit("")).otherwise(
        F.upper("lang")
    )


def _documents(
    spark: SparkSession, sf_dir: str, *columns: str, years: Sequence[int] | None = None, labelled: bool = True
) -> DataFrame:
    """Documents, of some years or all, with their quality label unless it is not asked for.

    Which join serves is left to Spark: labels are broadcast while their measured size
    is under the session's threshold and shuffled by doc_id beyond it.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", *columns)
    if years is not None:
        documents = documents.where(year_of(F.col("doc_id")).isin(sorted(set(years))))
    documents = spread(documents, "doc_id")
    if not labelled:
        return documents.withColumn("quality", F.lit(None).cast("int"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left")


def paper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and conference per paper, without reading any text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    year = year_of(F.col("doc_id"))
    return documents.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        year.alias("year"),
        F.concat_ws("_", "source", year.cast("string")).alias("conference"),
    )


def papers(spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, summaries: bool = True) -> DataFrame:
    """Papers of all years, or of some: the collection itself is laid out by year, these tables are not.

    Without ``summaries`` that column is null and the labels are not read.
    """
    text = normalise_nfkc(F.col("text"))
    documents = _documents(spark, sf_dir, "text", "lang", "source", years=years, labelled=summaries).withColumn("text", text)
    year = year_of(F.col("doc_id"))
    return documents.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        strip_to_ascii(F.substring_index("text", "\n", 1)).alias("title"),
        strip_to_ascii(F.col("text")).alias("abstract"),
        F.when(F.col("quality") == 1, strip_to_ascii(F.substring_index("text", "\n", -1))).alias("summary"),
        year.alias("year"),
        F.concat_ws("_", "source", year.cast("string")).alias("conference"),
        _venue().alias("venue"),
        F.array("lang", "source").alias("keywords"),
    )


def arriving_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of papers without summaries, file by file as they arrive.

    The table may be one file or a folder of files; the braces make a pattern of its
    name, since the file source takes a plain path for a folder.
    """
    schema = table(spark, sf_dir, "documents").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{documents.parquet}}")
    return files.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        strip_to_ascii(normalise_nfkc(F.col("text"))).alias("abstract"),
        F.lit(None).cast("string").alias("summary"),
    )


def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding, year and label of the papers that have a vector; no text is read."""
    vectors = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return vectors.select(
        F.col("vec_id").cast("string").alias("paper_id"), year_of(F.col("vec_id")).alias("year"), "label", "embedding"
    )


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as landed: even ids in the bare shape with a decision, odd ids wrapped without."""
    documents = _documents(spark, sf_dir, "text", "lang", "source")
    doc_id = F.col("doc_id").cast("string")
    decision = F.when(F.col("quality") == 1, "Accept").when(F.col("quality") == 0, "Reject")
    fields = {
        "title": F.substring_index("text", "\n", 1),
        "abstract": F.col("text"),
        "TL;DR": F.when(F.col("quality") == 1, F.substring_index("text", "\n", -1)).otherwise(F.lit("")),
        "authors": F.array("source"),
        "keywords": F.array("lang", "source"),
        "venue": _venue(),
    }
    bare = F.struct(*[c.alias(k) for k, c in fields.items()])
    wrapped = F.struct(*[F.struct(c.alias("value")).alias(k) for k, c in fields.items()])
    head = [doc_id.alias("id"), doc_id.alias("forum"), F.col("doc_id").cast("int").alias("number")]
    keep_nulls = {"ignoreNullFields": "false"}
    old = F.to_json(F.struct(*head, bare.alias("content"), decision.alias("decision")), keep_nulls)
    new = F.to_json(F.struct(*head, wrapped.alias("content")), keep_nulls)
    shaped = documents.select(
        F.concat_ws("_", "source", year_of(F.col("doc_id")).cast("string")).alias("conference"),
        F.when(F.col("doc_id") % 2 == 0, old).otherwise(new).alias("note"),
    )
    return notes_from_json(shaped)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = paper_keys(spark, sf_dir)
    return keys.select("conference", "paper_id", F.col("paper_id").alias("forum"))


def decision_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notes per labelled document: the decision first, a later toxicity note second."""
    labels = table(spark, sf_dir, "labels")
    notes = F.array(
        F.struct(F.lit(1).alias("note_order"), F.when(F.col("quality") == 1, "Accept").otherwise("Reject").alias("decision")),
        F.struct(F.lit(2).alias("note_order"), F.when(F.col("toxic") == 1, "Flagged").otherwise("Clear").alias("decision")),
    )
    return labels.select(F.col("doc_id").cast("string").alias("forum"), F.inline(notes))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, with a year added: the conversations themselves mention none."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    word = F.when(F.col("conv_id") % 3 == 0, " in ").when(F.col("conv_id") % 3 == 1, " since ").otherwise(" before ")
    year = (F.lit(FIRST_YEAR) + F.col("conv_id") % YEARS).cast("string")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(strip_to_ascii(normalise_nfkc(F.col("text"))), word, year).alias("question"),
    )


def summary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as an append-only log of summaries, later turns being newer."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return turns.select(
        F.col("conv_id").cast("string").alias("paper_id"),
        strip_to_ascii(normalise_nfkc(F.col("text"))).alias("summary"),
        F.col("turn").alias("ts"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a log of model runs: system turns stand for failed runs."""
    turns = table(spark, sf_dir, "conversations")
    failed = F.col("role") == "system"
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"),
        F.when(~failed, (F.col("turn") + 1).cast("double")).alias("seconds"),
        F.when(~failed, F.length("text")).alias("summary_chars"),
        F.when(failed, "no answer").alias("error"),
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns dressed up as raw model output with reasoning tags and bullets."""
    turns = table(spark, sf_dir, "conversations")
    text = F.col("text")
    response = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), F.col("role"), F.lit("</think> - "), text))
        .when(F.col("role") == "user", F.concat(F.lit("<think>"), text))
        .otherwise(F.concat(F.lit("* "), text))
    )
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
        response.alias("response"),
    )
