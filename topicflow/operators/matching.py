"""Many topics found in each text in one pass."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame, functions as F

#: Stands in for a topic's position where whole papers are counted.
_PAPERS = -1


class TopicMatcher:
    """An automaton over lower-cased topics; a topic's mentions in a text do not overlap, those of different topics may."""

    def __init__(self, needles: Sequence[str]) -> None:
        positions: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            positions.setdefault(needle, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for needle, own in positions.items():
            self.automaton.add_word(needle, (len(needle), own))
        self.automaton.make_automaton()

    def mentions(self, text: str) -> Counter:
        """How often each topic, by its position, occurs, from the left, as replacing it would find it."""
        free: dict[int, int] = {}
        found: Counter = Counter()
        for end, (size, own) in self.automaton.iter(text):
            if end - size + 1 >= free.get(own[0], 0):
                free[own[0]] = end + 1
                for i in own:
                    found[i] += 1
        return found


class _Mentions:
    """Position and mentions of every topic that a text holds; the automaton is built once a task."""

    def __init__(self, needles: Sequence[str]) -> None:
        self.needles, self.matcher = needles, None

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        if self.matcher is None:
            self.matcher = TopicMatcher(self.needles)
        return list(self.matcher.mentions(text or "").items())


def _lower(texts: DataFrame, topics: Sequence[str]) -> list[str]:
    """Topics in lower case as Spark has it."""
    if all(t.isascii() for t in topics):
        return [t.lower() for t in topics]
    return list(texts.sparkSession.range(1).select(F.transform(F.lit(list(topics)), F.lower).alias("t")).first()["t"])


def yearly_mentions(texts: DataFrame, topics: Sequence[str]) -> DataFrame:
    """``year, papers, rank, topic, mentions, papers_with_topic`` of ``texts`` (year, body) for every year that has texts, whatever the number of topics.

    Texts are read once and searched once. Python gets a few of them at a time, not an Arrow batch of thousands of whole texts,
    and counts are combined in the task: it passes on one row for each year and topic it has found.
    """
    find = F.udf(_Mentions(_lower(texts, topics)), "array<struct<pos: int, mentions: bigint>>", useArrow=False)
    found = texts.select(F.col("year").cast("int").alias("year"), find("body").alias("found"))
    whole = F.array(F.struct(F.lit(_PAPERS).alias("pos"), F.lit(0).cast("long").alias("mentions")))
    rows = found.select("year", F.inline(F.concat(whole, "found")))
    summed = rows.groupBy("year", "pos").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("papers"))
    is_topic = F.col("pos") != _PAPERS
    per_year = summed.groupBy("year").agg(
        F.max(F.when(~is_topic, F.col("papers"))).alias("papers"),
        F.map_from_entries(F.collect_list(F.when(is_topic, F.struct("pos", F.struct("mentions", "papers"))))).alias("found"),
    )
    each = per_year.select("year", "papers", "found", F.posexplode(F.lit(list(topics))).alias("pos", "topic"))
    of = lambda name: F.coalesce(F.try_element_at("found", F.col("pos"))[name], F.lit(0).cast("long"))
    return each.select("year", "papers", (F.col("pos") + 1).alias("rank"), "topic", of("mentions").alias("mentions"), of("papers").alias("papers_with_topic"))
