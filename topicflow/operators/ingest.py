"""From raw notes to the paper collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topicflow.functions.notes import string_list, string_of, text_field, wrapped_text
from topicflow.functions.text import clean_text


def flatten_notes(notes: DataFrame) -> DataFrame:
    """Raw notes as flat, cleaned columns, whichever of the two shapes they have."""
    content = F.col("content")
    return notes.select(
        "conference",
        F.col("id").alias("paper_id"),
        "forum",
        "number",
        clean_text(text_field(content, "TL;DR", "TLDR", "tl;dr")).alias("tldr"),
        clean_text(text_field(content, "title")).alias("title"),
        clean_text(text_field(content, "abstract")).alias("abstract"),
        string_list(content, "authors").alias("authors"),
        string_list(content, "keywords").alias("keywords"),
        wrapped_text(content, "venue").alias("venue"),
        string_of(F.col("decision")).alias("decision"),
        F.col("decision").isNotNull().alias("has_decision"),
    )


def with_required_fields(papers: DataFrame) -> DataFrame:
    return papers.where((F.length("title") > 0) & (F.length("abstract") > 0))


def merge_decisions(submissions: DataFrame, decision_notes: DataFrame) -> DataFrame:
    """Submissions with the first decision note of their forum, null where there is none.

    ``note_order`` gives the order of the notes. If several papers share a forum, an
    optional ``paper_order`` lets the last of them decide.
    """
    order = [(-F.col("paper_order")).alias("paper_order")] if "paper_order" in decision_notes.columns else []
    ranked = F.struct(*order, F.col("note_order"))
    first = decision_notes.groupBy("forum").agg(
        F.min_by(F.coalesce("decision", F.lit("")), ranked).alias("decision")
    )
    return submissions.join(first, "forum", "left")


def year_of_conference(conference: Column) -> Column:
    """The last four characters as a number, null if they are not one."""
    return F.right(conference, F.lit(4)).try_cast("int")


def to_collection(papers: DataFrame) -> DataFrame:
    """Collection rows of cleaned papers, including those whose year is unknown (null)."""
    return papers.select(
        "paper_id",
        "title",
        "abstract",
        "conference",
        F.coalesce("venue", F.lit("unknown")).alias("venue"),
        "keywords",
        year_of_conference(F.col("conference")).alias("year"),
        *[c for c in ("embedding", "summary") if c in papers.columns],
    )


def split_rejects(collection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the collection, and those without a year for a reject table."""
    return collection.where(F.col("year").isNotNull()), collection.where(F.col("year").isNull())
