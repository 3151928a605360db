"""Which topics occur together: document frequencies, shared papers, centrality.

Pairs of topics are formed within the row, from the topics a text holds, and counted with map-side combining: what is
shuffled is one number for each pair and task, however many papers there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from topicflow.operators.topics import TopicFinder, default_finder
from topicflow.operators.trends import distinct_topics, paper_texts

NODE_SCHEMA = "rank INT, topic STRING, papers BIGINT, centrality BIGINT"
EDGE_SCHEMA = "topic1 STRING, topic2 STRING, cooccurrence BIGINT"


@dataclass(frozen=True)
class TopicNetwork:
    nodes: DataFrame
    edges: DataFrame
    total_papers: DataFrame


def pair_counts(texts: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Papers that contain both topics i and j (positions, i <= j; i = j: the one topic).

    Pairs are formed within the row and counted with map-side combining, so a task sends one number per
    pair at most, however many papers it reads.
    """
    found = [F.when(F.contains(F.col("body"), F.lower(F.lit(t))), F.lit(i)) for i, t in enumerate(topics)]
    rows = texts.select(F.array_compact(F.array(*found)).alias("found"))
    pairs = F.flatten(
        F.transform("found", lambda i: F.transform(F.filter("found", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    return rows.select(F.inline(pairs)).groupBy("i", "j").agg(F.count("*").alias("papers"))


def _topic_at(position: str, topics: Sequence[str]) -> Column:
    return F.element_at(F.lit(list(topics)), F.col(position) + 1)


def document_frequencies(counts: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Papers containing each topic, zero included."""
    own = counts.where(F.col("i") == F.col("j")).select("i", "papers")
    return _positions(counts, topics).join(own, "i", "left").select(
        (F.col("i") + 1).alias("rank"),
        _topic_at("i", topics).alias("topic"),
        F.coalesce("papers", F.lit(0)).cast("long").alias("papers"),
    )


def _positions(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    return df.sparkSession.range(len(topics)).select(F.col("id").cast("int").alias("i"))


def cooccurrence(counts: DataFrame, topics: Sequence[str], min_cooccurrence: int = 2) -> DataFrame:
    """Papers shared by each ordered pair of different topics, from the minimum on."""
    pairs = counts.where(F.col("i") != F.col("j")).select("i", "j", F.col("papers").alias("n"))
    counts = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    if min_cooccurrence <= 0:
        positions = F.lit(list(range(len(topics))))
        every = _positions(counts, topics).select("i", F.explode(positions).alias("j")).where(F.col("i") != F.col("j"))
        counts = every.join(counts, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.where(F.col("n") >= min_cooccurrence).select(
        _topic_at("i", topics).alias("topic1"),
        _topic_at("j", topics).alias("topic2"),
        F.col("n").cast("long").alias("cooccurrence"),
    )


def centrality(frequencies: DataFrame, edges: DataFrame) -> DataFrame:
    """Topics with their number of partners, zero included."""
    degree = edges.where(F.col("cooccurrence") > 0).groupBy(F.col("topic1").alias("topic")).agg(F.count("*").alias("n"))
    return frequencies.join(degree, "topic", "left").select(
        "rank", "topic", "papers", F.coalesce("n", F.lit(0)).cast("long").alias("centrality")
    )


def topic_network(
    papers: DataFrame,
    year: int,
    min_cooccurrence: int = 2,
    n_topics: int = 30,
    topics: Sequence[str] | None = None,
    finder: TopicFinder = default_finder,
) -> TopicNetwork:
    """Topics of one year as nodes and edges; a year without papers gives empty frames."""
    texts = paper_texts(papers.where(F.col("year") == year))
    topics = distinct_topics(finder(texts, n_topics) if topics is None else topics)
    total = texts.agg(F.count("*").alias("total_papers"))
    if not topics:
        spark = papers.sparkSession
        return TopicNetwork(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), total)
    sets = pair_counts(texts, topics)
    edges = cooccurrence(sets, topics, min_cooccurrence)
    return TopicNetwork(centrality(document_frequencies(sets, topics), edges), edges, total)


def most_central(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("centrality"), "rank").limit(n)
