import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from topicflow.functions.words import STOP_WORDS
from topicflow.operators import network, topics as T, trends
from topicflow.sources import driver_tables as src

SF = "/root/testdata/sf0.001"


def grams_of(text):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def tfidf(texts, n, max_features=1000, min_documents=2):
    """Plain restatement of the scoring."""
    docs = [Counter(grams_of(t)) for t in texts]
    total, df = Counter(), Counter()
    for d in docs:
        total.update(d)
        df.update(d.keys())
    kept = sorted((t for t in total if df[t] >= min_documents), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    scores = defaultdict(float)
    for d in docs:
        weights = {t: c * idf[t] for t, c in d.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            scores[t] += w / norm
    return [(t, total[t], df[t]) for t in kept], sorted(scores.items(), key=lambda s: (-round(s[1], 6), s[0]))[:n]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = trends.paper_texts(src.papers(spark, SF)).select("paper_id", "body").cache()
    return texts, [r["body"] for r in texts.collect()]


@pytest.mark.parametrize("options", [{}, {"max_features": 7}, {"max_features": 300, "min_documents": 5}])
def test_top_terms(corpus, options):
    frame, texts = corpus
    kept, best = tfidf(texts, 12, **options)
    assert [tuple(r) for r in T.kept_terms(frame, **options).collect()] == kept
    rows = T.top_terms(frame, 12, **options).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
    assert [r["topic"] for r in rows] == [t for t, _ in best]
    assert [r["score"] for r in rows] == pytest.approx([s for _, s in best])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab cé", max_size=40), min_size=1, max_size=8), st.integers(1, 6))
def test_vocabulary_with_many_ties(spark, texts, max_features):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "paper_id INT, body STRING")
    kept, _ = tfidf(texts, 5, max_features=max_features)
    assert [tuple(r) for r in T.kept_terms(frame, max_features=max_features).collect()] == kept


def test_pruning_keeps_ties_at_the_cut(spark, monkeypatch):
    texts = ["aa bb cc dd", "aa bb cc dd", "ee ff", "ee ff"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "paper_id INT, body STRING")
    for fetched in (1, 2, 3, 100):
        monkeypatch.setattr(T, "FREQUENT_WORDS", fetched)
        for size in (1, 2, 3, 5, 8):
            assert [tuple(r) for r in T.kept_terms(frame, max_features=size).collect()] == tfidf(texts, 3, size)[0]


def test_nothing_to_find(spark):
    frame = spark.createDataFrame([("p", "one text only")], "paper_id STRING, body STRING")
    assert T.top_terms(frame).collect() == []
    assert T.top_terms(frame.where("false")).collect() == []


def test_model_topics_and_fallback(papers):
    texts = trends.paper_texts(papers)
    answering = lambda: lambda prompts: ["- graphs\n* text\n\ngraphs" for _ in prompts]

    def failing():
        def call(prompts):
            raise OSError("no model")

        return call

    assert T.topic_list(T.extract_topics(texts, 3, answering)) == ["graphs", "text"]
    assert T.topic_list(T.extract_topics(texts, 3, failing)) == T.topic_list(T.top_terms(texts, 3))


def test_selections_share_their_passes(papers):
    from topicflow.sources.papers import papers_of_years

    selections = [[2022, 2023, 2024], [2023, 2024, 2024], [2022], [1999]]
    together = T.terms_of_selections(trends.paper_texts(papers), selections, [5, 9, 4, 3])
    for years, n, found in zip(selections, [5, 9, 4, 3], together):
        assert found == T.topic_list(T.top_terms(trends.paper_texts(papers_of_years(papers, years)), n))
    assert together[3] == [] and together[0]


def test_topic_prompts_quote_every_character(spark):
    rows = [(f"{i:03d}", "word" * (30 * i)) for i in range(50)] + [("null", None), ("long", "x" * 9000)]
    frame = spark.createDataFrame(rows, "paper_id STRING, body STRING")
    prompts = T.topic_prompts(frame, 5, template="{texts}|{n}", chunk_chars=700).collect()
    quoted = [r["prompt"].removesuffix("|5") for r in prompts]
    assert sum(len(q.replace("\n", "")) for q in quoted) == sum(len(t or "") for _, t in rows)
    assert len({r["prompt_id"] for r in prompts}) == len(prompts) > 50 and max(map(len, quoted)) <= 2 * 700 + 60


def test_model_topics_count_the_prompts_that_name_them(spark):
    frame = spark.createDataFrame([(str(i), "a" * 100) for i in range(6)], "paper_id STRING, body STRING")

    def factory():
        return lambda prompts: [f"- common\n- only {len(p)}" if "a" in p else "" for p in prompts]

    rows = T.model_topics(frame, 3, factory, chunk_chars=100).collect()
    assert rows[0]["topic"] == "common" and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


TOPICS = ["graph", "image", "networks", "AI", "zzqx"]


def bodies(papers):
    rows = papers.collect()
    join = lambda r: f"{r['title'] or ''} {r['abstract'] or ''} {r['summary'] or ''}".lower()
    return [(r["year"], join(r)) for r in rows]


def test_trends(papers):
    got = trends.track_topic_trends(papers, TOPICS + ["graph", ""], 2021, 2024).collect()
    expected = set()
    for year in (2022, 2023, 2024):
        texts = [b for y, b in bodies(papers) if y == year]
        for rank, topic in enumerate(TOPICS, 1):
            n = sum(b.count(topic.lower()) for b in texts)
            having = sum(topic.lower() in b for b in texts)
            expected.add((rank, topic, year, n, having, len(texts), n / len(texts) * 100))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert trends.track_topic_trends(papers, [], 2021, 2024).collect() == []


def test_papers_per_year(papers):
    assert sorted(map(tuple, trends.papers_per_year(papers, 2021, 2024).collect())) == [
        (2021, 0), (2022, 2), (2023, 3), (2024, 4)]


def test_emerging(papers):
    finder = lambda texts, n: (
        ["image", "graph", "speech"] if texts.agg(F.max("year")).first()[0] == 2024 else ["graph", "networks"]
    )
    rows = {r["topic"]: r for r in trends.emerging_topics(papers, [2023, 2024], [2022], 0.1, finder=finder).collect()}
    texts = [b for y, b in bodies(papers) if y > 2022]
    image = sum(b.count("image") for b in texts) / len(texts)
    assert rows["image"]["growth_rate"] == pytest.approx(image) and rows["image"]["is_new"]
    assert not rows["image"]["seen_before"] and "graph" not in rows
    twice = trends.emerging_topics(papers, [2023, 2024, 2024], [2022, 2022], 0.1, finder=finder).first()
    assert (twice["total_recent_papers"], twice["total_comparison_papers"]) == (11, 4)
    assert trends.emerging_topics(papers, [1999], [1998]).collect() == []


@pytest.mark.parametrize(
    ("recent", "before", "growth", "new"), [(0.5, 0.25, 1.0, False), (0.05, 0.0, None, None), (0.1, 0.0, 0.1, True)]
)
def test_growth(spark, recent, before, growth, new):
    frame = spark.createDataFrame([(1, "t", recent, before)], "rank INT, topic STRING, recent_frequency DOUBLE, comparison_frequency DOUBLE")
    rows = [(r["growth_rate"], r["is_new"]) for r in trends.growth(frame).collect()]
    assert rows == ([] if growth is None else [(growth, new)])


@pytest.mark.parametrize("minimum", [0, 1, 2])
def test_network(papers, minimum):
    topics = ["graph", "image", "networks", "sparse", "zzqx"]
    net = network.topic_network(papers, 2023, minimum, topics=topics)
    texts = [b for y, b in bodies(papers) if y == 2023]
    sets = {t: {i for i, b in enumerate(texts) if t in b} for t in topics}
    edges = {(a, b): len(sets[a] & sets[b]) for a in topics for b in topics if a != b and len(sets[a] & sets[b]) >= minimum}
    assert {(r["topic1"], r["topic2"]): r["cooccurrence"] for r in net.edges.collect()} == edges
    nodes = {r["topic"]: (r["rank"], r["papers"], r["centrality"]) for r in net.nodes.collect()}
    assert nodes == {
        t: (i, len(sets[t]), sum(1 for (a, _), n in edges.items() if a == t and n > 0)) for i, t in enumerate(topics, 1)
    }
    assert net.total_papers.first()[0] == 3


def test_network_of_an_empty_year(papers):
    net = network.topic_network(papers, 1999)
    assert net.nodes.collect() == [] and net.edges.collect() == [] and net.total_papers.first()[0] == 0


def test_mentions_do_not_overlap():
    from topicflow.operators.matching import TopicMatcher

    topics = ["aa", "aaa", "ab", "b", "graph", "ph n", "aa"]
    texts = ["", "aaaa", "aaaaaab", "graph net graph nets", "abababab", "x" * 100_000 + "aa", "日本aa"]
    for text in texts:
        found = TopicMatcher(topics).mentions(text)
        assert [found[i] for i in range(len(topics))] == [text.count(t) for t in topics]


def test_many_topics_in_one_scan(papers):
    topics = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiourstnl"] + ["GRAPH", "Ähnlich"]
    found = trends.track_topic_trends(papers, topics, 2021, 2024)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2  # one and its copy in the initial plan
    rows = trends.paper_texts(papers).collect()
    for r in found.collect():
        bodies = [t.body for t in rows if t.year == r.year]
        needle = r.topic.lower()
        assert (r.mentions, r.papers_with_topic, r.papers) == (sum(b.count(needle) for b in bodies), sum(needle in b for b in bodies), len(bodies))
    assert found.count() == 3 * len(topics)


def test_texts_reach_the_matcher_a_few_at_a_time(papers):
    """Not in Arrow batches, of which a worker holds thousands of whole texts."""
    plan = trends.track_topic_trends(papers, ["graph", "image"], 2021, 2024)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_mentions_of_papers_without_text_or_year(spark):
    rows = [("p1", None, None, None, 2022), ("p2", "graph", "a graph", "graph", 2022), ("p3", "graph", None, None, None)]
    papers = spark.createDataFrame(rows, "paper_id STRING, title STRING, abstract STRING, summary STRING, year INT")
    found = trends.yearly_mentions(trends.paper_texts(papers), ["graph", "image"]).collect()
    got = {(r.year, r.rank): (r.topic, r.mentions, r.papers_with_topic, r.papers) for r in found}
    assert got == {(2022, 1): ("graph", 3, 1, 2), (2022, 2): ("image", 0, 0, 2), (None, 1): ("graph", 1, 1, 1), (None, 2): ("image", 0, 0, 1)}
