import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from topicflow.functions.prompts import TEMPLATES
from topicflow.operators.models import call_batch
from topicflow.operators import enrich as N
from topicflow.plans import report as P
from topicflow.streaming import enrichment as S


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shouting():
    return lambda texts: [f"<think>hm</think> {t.upper()}" for t in texts]


def picky():
    def call(texts):
        if any("graph" in t for t in texts):
            raise OSError("refused")
        return [t.upper() for t in texts]

    return call


def ids(df):
    return sorted(r["paper_id"] for r in df.collect())


def test_pending(spark, papers):
    assert ids(N.pending_summaries(papers)) == ["p1", "p2", "p4", "p5", "p7"]
    processed = spark.createDataFrame([("p1",), ("p3",)], "paper_id STRING")
    assert ids(N.pending_summaries(papers, processed)) == ["p2", "p4", "p5", "p7"]


def test_prompts(papers):
    rows = N.prompt_variants(papers.where("paper_id = 'p4'"), domain="biology").collect()
    assert len(rows) == len(TEMPLATES) == 4
    assert all("image networks with sparse codes" in r["prompt"] and "{" not in r["prompt"] for r in rows)
    assert "biology" in next(r["prompt"] for r in rows if r["template"] == "reviewer")
    stats = N.compare_prompts(papers.where("abstract <> ''"), picky).collect()
    assert {(r["prompts"], r["answers"], r["failures"]) for r in stats} == {(7, 0, 7), (7, 3, 4)}


def test_summarise(papers):
    rows = {r["paper_id"]: r for r in N.summarise(N.pending_summaries(papers), shouting).collect()}
    assert rows["p4"]["summary"] == "IMAGE NETWORKS WITH SPARSE CODES. IMAGE WORK." and rows["p4"]["attempts"] == 1
    failed = {r["paper_id"]: r for r in N.summarise(N.pending_summaries(papers).coalesce(1), picky).collect()}
    assert failed["p1"]["summary"] is None and failed["p1"]["attempts"] == 3 and "refused" in failed["p1"]["error"]
    counters = N.enrichment_counters(N.summarise(N.pending_summaries(papers).coalesce(1), picky)).first()
    assert (counters["processed"], counters["errors"]) == (2, 3)
    prompted = N.summarise_with_prompt(papers.where("paper_id = 'p4'"), shouting).first()
    assert "IMAGE NETWORKS" in prompted["summary"] and "FIRST-YEAR" in prompted["summary"]


def test_extractive_summary(spark):
    weights = spark.createDataFrame([("graph", 5), ("net", 3), ("café", 99)], "term STRING, weight LONG")
    model = N.ExtractiveSummary(weights, sentences=2)
    texts = ["None here. A graph! One net. graph net", "", "Only", None, "Plain words. Le café! Some graph. More graph."]
    papers = spark.createDataFrame(list(enumerate(texts)), "paper_id LONG, abstract STRING")
    got = N.summarise(papers, model)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["summary"] for r in got.orderBy("paper_id").collect()] == ["A graph! graph net", None, "Only", None, "Le café! Some graph."]


def test_failing_batches_are_halved():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise OSError("bad row")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(500)]
    texts[77] = "bad"
    results = call_batch(model, texts, 2, 0.0)
    assert [r for r, _, _ in results] == [None if t == "bad" else t.upper() for t in texts]
    assert len(calls) < 30 and results[77][1:] == ("OSError: bad row", 2)


def test_run_statistics(spark):
    log = spark.createDataFrame(
        [("a", 2.0, 10, None), ("b", 4.0, 30, None), ("c", None, None, "late")],
        "id STRING, seconds DOUBLE, summary_chars INT, error STRING",
    )
    row = N.run_statistics(log).first()
    assert (row["runs"], row["failed"], row["mean_seconds"], row["total_seconds"]) == (3, 1, 2.0, 6.0)
    assert row["corpus_hours"] == pytest.approx(2.0 * 13223 / 3600)
    assert N.run_statistics(log.where("false")).first()["mean_seconds"] is None


@pytest.fixture
def arrivals(spark, papers, tmp_path):
    """A folder of paper files, a stream over it, and a runner."""
    folder, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    papers.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(papers.schema).parquet(folder)

    def run(model, **options):
        S.start_enrichment(stream, results, checkpoint, model, **options).awaitTermination()
        return S.read_results(spark, results)

    return folder, results, run


def test_stream_resumes(spark, papers, arrivals):
    folder, results, run = arrivals
    assert S.read_results(spark, results).collect() == []
    assert ids(run(shouting)) == ["p1", "p2", "p4", "p5", "p7"]
    assert run(shouting).count() == 5
    more = papers.limit(1).withColumn("paper_id", F.lit("p99")).union(papers.where("paper_id = 'p4'"))
    more.coalesce(1).write.mode("append").parquet(folder)
    assert ids(run(shouting)) == ["p1", "p2", "p4", "p5", "p7", "p99"]


def test_failures_stay_eligible(spark, papers, arrivals):
    _, results, run = arrivals
    assert run(picky, max_failure_ratio=1.0).where("summary is null").count() == 3
    S.retry_failed(papers, results, shouting)
    assert ids(S.processed_ids(S.read_results(spark, results))) == ["p1", "p2", "p4", "p5", "p7"]
    S.retry_failed(papers, results, shouting)
    assert S.read_results(spark, results).count() == 8


def test_failure_ceiling_holds_the_batch_back(arrivals):
    _, _, run = arrivals
    with pytest.raises(StreamingQueryException, match="failed"):
        run(picky, max_failure_ratio=0.5)
    results = run(shouting, max_failure_ratio=0.5)
    assert ids(S.processed_ids(results)) == ["p1", "p2", "p4", "p5", "p7"]
    assert ids(results.where("summary is not null")) == ["p1", "p2", "p4", "p5", "p7"]


def test_report(spark, papers, tmp_path):
    finder = lambda texts, n: ["graph", "image", "networks", "speech"]
    report = P.trend_report(papers, 2022, 2024, finder=finder)
    assert report.overlapping_years == (2023,)
    P.save_report(report, str(tmp_path / "report"))
    document = json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()))
    assert document["total_papers"] == 9 and document["year_range"] == [2022, 2024]
    assert [t["topic"] for t in document["key_topics"]] == ["graph", "image", "networks", "speech"]
    assert len(document["topic_trends"]) == 12 and document["papers_per_year"][0] == {"year": 2022, "papers": 2}
    P.save_report_lines(report, str(tmp_path / "lines"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert lines[0] == "papers from 2022 to 2024 | 9" and lines[1:4] == ["papers in 2022 | 2", "papers in 2023 | 3", "papers in 2024 | 4"]
    assert lines[4] == "topic 1 | graph" and any(line.startswith("rising 1 |") and line.endswith("| new") for line in lines)
    facts = {(r["section"], r["item"], r["detail"]): r["value"] for r in P.report_facts(report).collect()}
    assert facts["papers_per_year", "2023", ""] == 3 and facts["centrality", "image", ""] == 1
    assert P.chart_topic_trends(report, 2).count() == 6 and P.chart_centrality(report, 2).count() == 2


def test_report_of_an_empty_range(papers):
    report = P.trend_report(papers, 1990, 1992)
    assert report.key_topics.collect() == [] and report.topic_trends.collect() == []
    assert report.total_papers.first()[0] == 0 and report.relationships.nodes.collect() == []
