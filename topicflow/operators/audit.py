"""Completeness checks over notes and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMPTY_VENUE = "<empty venue>"


def _blank(column: str) -> Column:
    return F.length(F.coalesce(F.col(column), F.lit(""))) == 0


def schema_profile(notes: DataFrame) -> DataFrame:
    """How many notes of each conference carry each key, and the types seen there."""
    keys = notes.lateralJoin(notes.sparkSession.tvf.variant_explode_outer(F.col("content").outer()))
    return keys.groupBy("conference", "key").agg(
        F.count("*").alias("notes"), F.schema_of_variant_agg("value").alias("value_type")
    )


def decision_coverage(papers: DataFrame) -> DataFrame:
    """Submissions and decisions per conference; a conference without the field is reported at zero."""
    n, decided = F.count("*"), F.count("decision")
    return papers.groupBy("conference").agg(
        n.alias("submissions"),
        decided.alias("with_decision"),
        (decided / n * 100).alias("percentage"),
        F.bool_and("has_decision").alias("decisions_available"),
    )


def missing_fields(papers: DataFrame) -> DataFrame:
    return papers.groupBy("conference").agg(
        F.count_if(_blank("title")).alias("missing_title"),
        F.count_if(_blank("abstract")).alias("missing_abstract"),
        F.count_if(_blank("tldr")).alias("missing_tldr"),
    )


def venue_histogram(papers: DataFrame) -> DataFrame:
    """Papers per lower-cased venue, plus one line per conference for those without a venue."""
    given = F.coalesce(F.col("venue").rlike("(?U)\\S"), F.lit(False))
    counts = papers.groupBy("conference", F.when(given, F.lower("venue")).alias("venue")).agg(
        F.count("*").alias("papers")
    )
    named = counts.where(F.col("venue").isNotNull()).withColumn("is_empty", F.lit(False))
    empty = counts.groupBy("conference").agg(
        F.lit(EMPTY_VENUE).alias("venue"),
        F.sum(F.when(F.col("venue").isNull(), F.col("papers")).otherwise(0)).alias("papers"),
        F.lit(True).alias("is_empty"),
    )
    return named.unionByName(empty).orderBy("conference", "is_empty", F.desc("papers"), "venue")


def summary_coverage(papers: DataFrame) -> DataFrame:
    """Papers with and without a summary; those without an abstract are counted apart."""
    no_abstract, no_summary = _blank("abstract"), _blank("summary")
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(~no_abstract & ~no_summary).alias("with_summary"),
        F.count_if(~no_abstract & no_summary).alias("without_summary"),
        F.count_if(no_abstract).alias("without_abstract"),
    )


def summary_samples(papers: DataFrame, n: int = 5) -> DataFrame:
    """The first papers by id, shortened for display."""
    return papers.orderBy("paper_id").limit(n).select(
        "paper_id",
        F.left("title", F.lit(100)).alias("title"),
        (~_blank("abstract")).alias("has_abstract"),
        (~_blank("summary")).alias("has_summary"),
        F.left("summary", F.lit(200)).alias("summary"),
    )
