"""The composite trend report and its presentation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from topicflow.operators.network import TopicNetwork, most_central, topic_network
from topicflow.operators.topics import TopicFinder, default_finder
from topicflow.operators.trends import (
    distinct_topics,
    emerging_topics,
    papers_per_year,
    status_label,
    topics_of_selections,
    track_topic_trends,
)

SHOWN = 10


@dataclass(frozen=True)
class TrendReport:
    """The parts of a report as frames; nothing is computed beyond the topic lists until one is used."""

    first_year: int
    last_year: int
    key_topics: DataFrame
    papers_per_year: DataFrame
    topic_trends: DataFrame
    emerging_topics: DataFrame
    relationships: TopicNetwork
    overlapping_years: tuple[int, ...]

    @property
    def total_papers(self) -> DataFrame:
        return self.papers_per_year.agg(F.sum("papers").alias("total_papers"))


def trend_report(
    papers: DataFrame,
    first_year: int,
    last_year: int,
    key_topics: Sequence[str] | None = None,
    finder: TopicFinder = default_finder,
) -> TrendReport:
    """Trends of the key topics, emerging topics of the last against the first two years, and
    the topic network of the last year. For ranges under four years the two periods overlap."""
    recent, before = [last_year - 1, last_year], [first_year, first_year + 1]
    selections = [list(range(first_year, last_year + 1)), recent, before, [last_year]]
    found, *of_periods, of_last = topics_of_selections(papers, selections, (15, 20, 20, 30), finder)
    topics = distinct_topics(key_topics) if key_topics else found
    listed = papers.sparkSession.createDataFrame(list(enumerate(topics, 1)), "rank INT, topic STRING")
    return TrendReport(
        first_year,
        last_year,
        listed,
        papers_per_year(papers, first_year, last_year),
        track_topic_trends(papers, topics, first_year, last_year),
        emerging_topics(papers, recent, before, topics=tuple(of_periods)),
        topic_network(papers, last_year, topics=of_last),
        tuple(sorted(set(recent) & set(before))),
    )


def report_facts(report: TrendReport) -> DataFrame:
    """Every number of the report in long form: section, item, detail, value."""

    def facts(df: DataFrame, section: str, item: str, detail: str, value: str) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            F.expr(item).cast("string").alias("item"),
            F.expr(detail).cast("string").alias("detail"),
            F.expr(value).cast("double").alias("value"),
        )

    network = report.relationships
    parts = [
        facts(report.papers_per_year, "papers_per_year", "year", "''", "papers"),
        facts(report.key_topics, "key_topics", "topic", "''", "rank"),
        facts(report.topic_trends, "trend_mentions", "topic", "year", "mentions"),
        facts(report.topic_trends, "trend_percentage", "topic", "year", "percentage"),
        facts(report.emerging_topics, "emerging_growth", "topic", "if(is_new, 'NEW', 'GROWING')", "growth_rate"),
        facts(network.nodes, "topic_frequency", "topic", "''", "papers"),
        facts(network.nodes, "centrality", "topic", "''", "centrality"),
        facts(network.edges, "cooccurrence", "topic1", "topic2", "cooccurrence"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def report_document(report: TrendReport) -> DataFrame:
    """The report as one JSON document (column ``value``), topics and edges bounded by the topic counts."""
    network = report.relationships

    def rows(df: DataFrame, *order: str) -> DataFrame:
        fields = F.struct(*order, *[c for c in df.columns if c not in order])
        return df.agg(F.array_sort(F.collect_list(fields)).alias("rows"))

    parts = {
        "papers_per_year": rows(report.papers_per_year, "year"),
        "key_topics": rows(report.key_topics, "rank"),
        "topic_trends": rows(report.topic_trends, "rank", "year"),
        "emerging_topics": rows(report.emerging_topics, "rank"),
        "topics": rows(network.nodes, "rank"),
        "cooccurrence": rows(network.edges, "topic1", "topic2"),
    }
    head = report.total_papers.select(
        F.array(F.lit(report.first_year), F.lit(report.last_year)).alias("year_range"),
        F.lit(list(report.overlapping_years)).cast("array<int>").alias("overlapping_years"),
        "total_papers",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    )
    for name, part in parts.items():
        head = head.withColumn(name, part.scalar())
    return head.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def save_report(report: TrendReport, path: str) -> None:
    report_document(report).write.mode("overwrite").text(path)


def report_lines(report: TrendReport) -> DataFrame:
    """The report in one line per fact (section, line_no, line): the years covered, papers by year, topics, rising topics. No date."""
    covered = F.format_string(f"papers from {report.first_year} to {report.last_year} | %d", "total_papers")
    rising = F.format_string("rising %d | %s | %+.1f %% | %s", "position", "topic", _one_decimal(F.col("growth_rate") * 100), F.lower("status"))
    lines = [
        report.total_papers.select(F.lit(0).alias("section"), F.lit(0).alias("line_no"), covered.alias("line")),
        report.papers_per_year.select(F.lit(1).alias("section"), F.col("year").alias("line_no"), F.format_string("papers in %d | %d", "year", "papers").alias("line")),
        report.key_topics.where(F.col("rank") <= SHOWN).select(
            F.lit(2).alias("section"), F.col("rank").alias("line_no"), F.format_string("topic %d | %s", "rank", "topic").alias("line")
        ),
        top_emerging(report.emerging_topics).select(F.lit(3).alias("section"), F.col("position").alias("line_no"), rising.alias("line")),
    ]
    result = lines[0]
    for part in lines[1:]:
        result = result.unionByName(part)
    return result.orderBy("section", "line_no")


def _one_decimal(value: Column) -> Column:
    """Ties go to the even digit; the format itself would round them up."""
    return F.bround(value, 1)


def save_report_lines(report: TrendReport, path: str) -> None:
    report_lines(report).select("line").coalesce(1).write.mode("overwrite").text(path)


def top_emerging(emerging: DataFrame, n: int = SHOWN) -> DataFrame:
    """The n fastest growing topics with their label and position."""
    first = emerging.orderBy(F.desc("growth_rate"), "rank").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("growth_rate")).alias("order"), "rank", "topic", "growth_rate", "is_new")))
    return first.agg(ordered.alias("rows")).select(F.posexplode("rows").alias("pos", "r")).select(
        (F.col("pos") + 1).cast("int").alias("position"), "r.topic", "r.growth_rate", "r.is_new"
    ).withColumn("status", status_label())


def chart_topic_trends(report: TrendReport, topics: int = 5) -> DataFrame:
    return report.topic_trends.where(F.col("rank") <= topics).select("topic", "year", "percentage")


def chart_centrality(report: TrendReport, n: int = SHOWN) -> DataFrame:
    return most_central(report.relationships.nodes, n).select("topic", "centrality")
