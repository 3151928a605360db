"""The paper collection and the tables around it: storage layout and readers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from topicflow.operators.bounded import first_keys

MAX_BROADCAST_IDS = 1_000_000

CLEAN_SCHEMA = (
    "conference STRING, paper_id STRING, forum STRING, number INT, tldr STRING, title STRING, abstract STRING, "
    "authors ARRAY<STRING>, keywords ARRAY<STRING>, venue STRING, decision STRING, has_decision BOOLEAN"
)


def write_clean(papers: DataFrame, path: str) -> None:
    papers.hint("rebalance", "conference").write.mode("overwrite").partitionBy("conference").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_SCHEMA).parquet(path)


def write_collection(papers: DataFrame, path: str) -> None:
    """Replace the collection, laid out by year so that year filters skip whole folders.

    The rebalance hint lets adaptive execution split a year that dominates and merge
    small ones, so neither one huge task nor thousands of tiny files come out.
    """
    papers.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_summary_column(papers: DataFrame) -> DataFrame:
    """Add the late ``summary`` column to a collection stored before it existed."""
    if "summary" in papers.columns:
        return papers
    return papers.withColumn("summary", F.lit(None).cast("string"))


def papers_of_year(papers: DataFrame, year: int | None = None, limit: int | None = None) -> DataFrame:
    """Papers of one year, or all when no year is given; an optional limit keeps the lowest ids."""
    if year:
        papers = papers.where(F.col("year") == year)
    return papers if limit is None else papers.orderBy("paper_id").limit(limit)


def papers_of_years(papers: DataFrame, years: Sequence[int], limit_per_year: int | None = None) -> DataFrame:
    """Papers of several years appended; a year listed twice contributes its papers twice.

    A limit keeps the papers with the lowest ids of each year. Those are found from the ids alone; they are as many as years times the limit, and so
    are broadcast to a second scan, while that is below ``MAX_BROADCAST_IDS``.
    """
    wanted = sorted(set(years))
    selected = papers.where(F.col("year").isin(wanted))
    if limit_per_year is not None:
        kept = first_keys(selected.select("year", "paper_id"), "year", "paper_id", limit_per_year)
        bounded = len(wanted) * limit_per_year <= MAX_BROADCAST_IDS
        selected = selected.join(F.broadcast(kept) if bounded else kept, ["year", "paper_id"], "left_semi").select(*papers.columns)
    for year, times in Counter(years).items():
        if times > 1:
            copies = F.sequence(F.lit(1), F.when(F.col("year") == year, F.lit(times)).otherwise(F.lit(1)))
            selected = selected.withColumn("_copy", F.explode(copies)).drop("_copy")
    return selected


def enrichment_view(papers: DataFrame) -> DataFrame:
    """The three narrow fields an enrichment run needs."""
    return papers.select(
        "paper_id", "abstract", (F.length(F.coalesce("summary", F.lit(""))) > 0).alias("has_summary")
    )


def latest_summaries(log: DataFrame) -> DataFrame:
    """Newest successful summary per paper of an append-only log (paper_id, summary, ts)."""
    done = log.where(F.length("summary") > 0)
    return done.groupBy("paper_id").agg(F.max(F.struct("ts", "summary")).alias("_last")).select(
        "paper_id", F.col("_last.summary").alias("summary")
    )


def apply_summaries(papers: DataFrame, log: DataFrame) -> DataFrame:
    """The collection with its summaries brought up to date from the log."""
    newest = latest_summaries(log).withColumnRenamed("summary", "_new")
    joined = with_summary_column(papers).join(newest, "paper_id", "left")
    return joined.withColumn("summary", F.coalesce("_new", "summary")).drop("_new")
