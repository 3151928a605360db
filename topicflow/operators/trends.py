"""How often topics are mentioned year by year, and which topics are emerging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from topicflow.functions.text import analysis_text, matched_bytes
from topicflow.operators.matching import yearly_mentions
from topicflow.operators.topics import TopicFinder, default_finder, terms_of_selections
from topicflow.sources.papers import papers_of_years

TREND_SCHEMA = "rank INT, topic STRING, year INT, mentions BIGINT, papers_with_topic BIGINT, papers BIGINT, percentage DOUBLE"


def paper_texts(papers: DataFrame) -> DataFrame:
    """Id, year and the lower-cased text on which topics are matched."""
    return papers.select("paper_id", "year", analysis_text().alias("body"))


def distinct_topics(topics: Sequence[str]) -> list[str]:
    """Topics in order without repeats and empty entries, which would match everywhere."""
    return [t for t in dict.fromkeys(topics) if t]


def papers_per_year(papers: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Papers of every year in the range, zero where there are none."""
    counts = papers.where(F.col("year").between(first_year, last_year)).groupBy("year").agg(F.count("*").alias("n"))
    years = papers.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("papers"))


def _needle(topic: str) -> Column:
    return F.lower(F.lit(topic))


def _with_matches(texts: DataFrame, topics: Sequence[str], *columns: str | Column) -> DataFrame:
    """The given columns and the matched bytes of each topic (match_0, match_1, ...), each text searched once."""
    found = [matched_bytes(F.col("body"), _needle(t)).alias(f"match_{i}") for i, t in enumerate(topics)]
    return texts.select(*columns, *found)


def _mentions(found_bytes: Column, topic: Column) -> Column:
    return (F.coalesce(found_bytes, F.lit(0)) / F.octet_length(F.lower(topic))).cast("long")


def track_topic_trends(papers: DataFrame, topics: Sequence[str], first_year: int, last_year: int) -> DataFrame:
    """Mentions of each topic in each year that has papers, and mentions per 100 papers.

    Matching is by substring and ignores case. Mentions are counted within a paper, never
    across the boundary of two. The list of topics may be long: texts are searched once for all of them.
    """
    topics = distinct_topics(topics)
    if not topics:
        return papers.sparkSession.createDataFrame([], TREND_SCHEMA)
    texts = paper_texts(papers.where(F.col("year").between(first_year, last_year)))
    counts = yearly_mentions(texts, topics)
    return counts.select(
        F.col("rank").cast("int").alias("rank"),
        "topic",
        "year",
        "mentions",
        "papers_with_topic",
        "papers",
        (F.col("mentions") / F.col("papers") * 100).alias("percentage"),
    )


def period_frequencies(
    papers: DataFrame,
    recent_topics: Sequence[str],
    comparison_topics: Sequence[str],
    recent_years: Sequence[int],
    comparison_years: Sequence[int],
) -> DataFrame:
    """Mentions per paper of the recent topics in both periods, in one pass over the papers.

    A topic that is not among the comparison topics has comparison frequency zero, even
    if it occurs there; ``seen_before`` tells whether it does. Years listed twice weigh twice.
    """
    weight_recent, weight_comparison = _weight(recent_years), _weight(comparison_years)
    texts = paper_texts(papers.where(F.col("year").isin(sorted({*recent_years, *comparison_years}))))
    matches = _with_matches(texts, recent_topics, weight_recent.alias("w_recent"), weight_comparison.alias("w_comparison"))
    aggregates = [F.sum("w_recent").alias("recent_total"), F.sum("w_comparison").alias("comparison_total")]
    for i in range(len(recent_topics)):
        for period in ("recent", "comparison"):
            aggregates.append(F.sum(F.col(f"match_{i}") * F.col(f"w_{period}")).alias(f"{period}_{i}"))
    known = set(comparison_topics)
    rows = []
    for i, topic in enumerate(recent_topics):
        before = _mentions(F.col(f"comparison_{i}"), F.lit(topic))
        rows.append(
            F.struct(
                F.lit(i + 1).alias("rank"),
                F.lit(topic).alias("topic"),
                _mentions(F.col(f"recent_{i}"), F.lit(topic)).alias("recent_mentions"),
                (before if topic in known else F.lit(0).cast("long")).alias("comparison_mentions"),
                (before > 0).alias("seen_before"),
            )
        )
    rate = lambda mentions, total: F.coalesce(F.try_divide(F.col(mentions), F.col(total)), F.lit(0.0))
    return (
        matches.agg(*aggregates)
        .select("recent_total", "comparison_total", F.inline(F.array(*rows)))
        .select(
            "rank",
            "topic",
            rate("recent_mentions", "recent_total").alias("recent_frequency"),
            rate("comparison_mentions", "comparison_total").alias("comparison_frequency"),
            "seen_before",
            F.col("recent_total").alias("total_recent_papers"),
            F.col("comparison_total").alias("total_comparison_papers"),
        )
    )


def _weight(years: Sequence[int]) -> Column:
    weight = F.lit(0)
    for year in sorted(set(years)):
        weight = F.when(F.col("year") == year, F.lit(list(years).count(year))).otherwise(weight)
    return weight.cast("long")


def growth(frequencies: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Growth of each topic, kept from the threshold on, strongest first; ties keep the topic rank."""
    recent, before = F.col("recent_frequency"), F.col("comparison_frequency")
    rate = F.when(before > 0, (recent - before) / before).otherwise(recent)
    return (
        frequencies.withColumn("growth_rate", rate)
        .withColumn("is_new", before == 0)
        .where(F.col("growth_rate") >= threshold)
        .orderBy(F.desc("growth_rate"), "rank")
    )


def topics_of_selections(
    papers: DataFrame, selections: Sequence[Sequence[int]], n: Sequence[int], finder: TopicFinder = default_finder
) -> list[list[str]]:
    """Topics of several selections of years. The default finder serves them all in the same passes."""
    if finder is default_finder:
        found = terms_of_selections(paper_texts(papers), selections, n)
    else:
        found = [finder(paper_texts(papers_of_years(papers, years)), size) for years, size in zip(selections, n)]
    return [distinct_topics(topics) for topics in found]


EMERGING_SCHEMA = (
    "rank INT, topic STRING, recent_frequency DOUBLE, comparison_frequency DOUBLE, seen_before BOOLEAN, "
    "total_recent_papers BIGINT, total_comparison_papers BIGINT, growth_rate DOUBLE, is_new BOOLEAN"
)


def emerging_topics(
    papers: DataFrame,
    recent_years: Sequence[int],
    comparison_years: Sequence[int],
    threshold: float = 0.1,
    n_topics: int = 20,
    finder: TopicFinder = default_finder,
    topics: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """Topics of the recent years that are new or mentioned more often than before.

    ``topics`` gives those of both periods where they are known already.
    """
    selections = (recent_years, comparison_years)
    recent, before = topics or topics_of_selections(papers, selections, (n_topics, n_topics), finder)
    if not recent:
        return papers.sparkSession.createDataFrame([], EMERGING_SCHEMA)
    return growth(period_frequencies(papers, recent, before, recent_years, comparison_years), threshold)


def status_label(is_new: str = "is_new") -> Column:
    return F.when(F.col(is_new), "NEW").otherwise("GROWING")
