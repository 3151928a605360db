"""Chunked runs, deadlines and the breaker."""

import pathlib
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from topicflow.operators.calls import CallPolicy, Outcome, Scheduler, call_model
from topicflow.streaming import chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def policy(**options):
    return CallPolicy(**{"pauses": {"connection": 0.01}, **options})


def run(call, texts, **options):
    return Scheduler(call, policy(**options)).run(texts)


def shout(texts):
    return [t.upper() for t in texts]


def test_outcomes_keep_the_order():
    found = run(lambda t: (time.sleep(0.02 * (len(t[0]) % 3)), shout(t))[1], [f"{'x' * (i % 5)}{i}" for i in range(40)], in_flight=8)
    assert [o.result for o in found] == [f"{'X' * (i % 5)}{i}" for i in range(40)]
    assert {o.status for o in found} == {"done"} and run(shout, []) == []


def test_a_hanging_call_costs_one_deadline():
    def call(texts):
        if texts[0] == "hang":
            time.sleep(30)
        return shout(texts)

    started = time.monotonic()
    found = run(call, ["a", "hang", "b", "c"], deadline=0.5)
    assert time.monotonic() - started < 5
    assert [o.result for o in found] == ["A", None, "B", "C"]
    assert (found[1].status, found[1].kind, found[1].attempts) == ("failed", "timeout", 1)


def test_errors_by_kind():
    seen = []

    def call(texts):
        seen.append(texts[0])
        if texts[0] == "away" and seen.count("away") < 3:
            raise ConnectionError("away")
        if texts[0] == "bad":
            raise ValueError("bad")
        if texts[0] == "gone":
            raise ConnectionRefusedError("gone")
        return shout(texts)

    found = run(call, ["away", "bad", "gone", "ok"], attempts=3)
    assert [(o.status, o.kind, o.attempts) for o in found] == [("done", None, 3), ("failed", "error", 1), ("failed", "connection", 3), ("done", None, 1)]
    assert found[1].error == "ValueError: bad"


def test_pauses_grow():
    scheduler = Scheduler(shout, policy(attempts=5, pauses={"connection": 0.1}, longest_pause=0.3, max_failures=None))
    pauses = [scheduler._settle(Outcome(), None, ConnectionError(), attempt) for attempt in range(1, 6)]
    assert pauses == [0.1, 0.2, 0.3, 0.3, None]
    assert scheduler._settle(Outcome(), None, ValueError(), 1) is None
    moments = []

    def call(texts):
        moments.append(time.monotonic())
        raise ConnectionError

    run(call, ["x"], attempts=3, pauses={"connection": 0.1})
    assert len(moments) == 3 and moments[1] - moments[0] >= 0.1 and moments[2] - moments[1] >= 0.2


@pytest.mark.parametrize("in_flight", [1, 8])
def test_no_more_calls_than_the_breaker_allows(in_flight):
    calls = []

    def call(texts):
        calls.append(texts[0])
        raise ValueError

    found = run(call, [str(i) for i in range(100)], in_flight=in_flight, max_failures=5)
    assert len(calls) == 5
    assert [o.status for o in found].count("failed") == 5 and [o.status for o in found].count("skipped") == 95


def test_failures_in_between_do_not_open():
    def call(texts):
        if int(texts[0]) % 3:
            raise ValueError
        return texts

    assert {o.status for o in run(call, [str(i) for i in range(60)], max_failures=3)} == {"done", "failed"}


def always_failing():
    def call(texts):
        raise ConnectionError("away")

    return call


def test_calls_of_a_model_that_is_away(spark):
    papers = spark.range(1000).select(F.col("id").cast("string").alias("paper_id"), F.lit("text").alias("abstract")).repartition(4)
    found = call_model(papers, always_failing, "paper_id", "abstract", "summary", policy(max_failures=6, attempts=2))
    counts = {r["status"]: (r["n"], r["calls"]) for r in found.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("calls")).collect()}
    assert counts["failed"][0] + counts["skipped"][0] == 1000 and counts["failed"][1] + counts["skipped"][1] <= 6 * 4


@pytest.fixture
def arrivals(spark, tmp_path):
    """One file of 50 papers, two of them nothing to do, and a stream over its folder."""
    rows = [(f"p{i}", None if i == 7 else f"text {i}", "there" if i == 9 else None) for i in range(50)] + [("p1", "text 1", None)]
    schema = "paper_id STRING, abstract STRING, summary STRING"
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    return spark.readStream.schema(schema).parquet(source), source, folder


def shouting():
    return shout


def test_a_stopped_run_goes_on_at_the_next_chunk(spark, arrivals):
    papers, source, folder = arrivals
    chunks.land_papers(papers, folder, 10)
    assert spark.read.parquet(f"{folder}/landed").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 10
    assert not chunks.run_chunks(spark, folder, shouting, max_chunks=3)
    first = chunks.read_outcomes(spark, folder)
    assert sorted(r[0] for r in first.select("chunk").distinct().collect()) == [0, 1, 2]
    assert chunks.run_chunks(spark, folder, shouting)
    found = chunks.read_outcomes(spark, folder).collect()
    assert len(found) == len({r.paper_id for r in found}) == 48 and {r.attempt for r in found} == {0} and max(r.chunk for r in found) >= 4
    assert all(r.summary == r_text for r, r_text in ((r, f"TEXT {r.paper_id[1:]}") for r in found))
    # nothing new, then one new paper and one that was there
    spark.createDataFrame([("p1", "text 1", None), ("p99", "text 99", None)], "paper_id STRING, abstract STRING, summary STRING").write.mode("append").parquet(source)
    for _ in range(2):
        chunks.land_papers(papers, folder, 10)
        assert chunks.run_chunks(spark, folder, shouting)
    assert {r.paper_id for r in chunks.read_summaries(spark, folder).collect()} == {r.paper_id for r in found} | {"p99"}
    assert chunks.read_outcomes(spark, folder).count() == 49


def test_a_model_that_is_away_ends_the_run(spark, arrivals):
    papers, _, folder = arrivals
    chunks.land_papers(papers, folder, 20)
    assert not chunks.run_chunks(spark, folder, always_failing, policy(max_failures=4, attempts=1))
    assert not chunks.run_chunks(spark, folder, always_failing, policy(max_failures=4, attempts=1))
    told = {(r.chunk, r.attempt): r for r in chunks.read_counters(spark, folder).collect()}
    assert set(told) == {(0, 0), (0, 1)}
    assert told[0, 0].errors == 4 and told[0, 1].errors == 1 and told[0, 0].calls == 4 and told[0, 1].calls == 1
    assert chunks.run_chunks(spark, folder, shouting)
    counters = chunks.read_counters(spark, folder)
    assert counters.agg(F.sum("processed")).first()[0] == 48 == chunks.read_summaries(spark, folder).count()
    by_status = {r["status"]: r["count"] for r in chunks.read_outcomes(spark, folder).groupBy("status").count().collect()}
    assert by_status["failed"] == counters.agg(F.sum("errors")).first()[0] == 5
    assert by_status["skipped"] == counters.agg(F.sum("skipped")).first()[0]


def test_done_papers_of_a_stopped_chunk_are_not_called_again(spark, arrivals):
    papers, _, folder = arrivals
    chunks.land_papers(papers, folder, 100)

    def goes_away():
        calls = []

        def call(texts):
            calls.append(texts)
            if len(calls) > 10:
                raise ConnectionError
            return shout(texts)

        return call

    assert not chunks.run_chunks(spark, folder, goes_away, policy(max_failures=2, attempts=1))
    assert chunks.run_chunks(spark, folder, shouting)
    done = chunks.read_outcomes(spark, folder).where("status = 'done'")
    assert done.count() == done.select("paper_id").distinct().count() == 48
    assert {r.attempt: r["count"] for r in done.groupBy("attempt").count().collect()} == {0: 10, 1: 38}


def test_other_failures_are_raised(spark, arrivals):
    papers, _, folder = arrivals
    chunks.land_papers(papers, folder, 100)

    def broken():
        raise OSError("no such model")

    with pytest.raises(Exception, match="no such model"):
        chunks.run_chunks(spark, folder, broken)


def test_many_chunks_take_few_batches(spark, arrivals):
    papers, _, folder = arrivals
    chunks.land_papers(papers, folder, 1)
    assert not chunks.run_chunks(spark, folder, shouting, max_chunks=6)
    assert sorted(r.chunk for r in chunks.read_outcomes(spark, folder).collect()) == list(range(6))
    assert chunks.run_chunks(spark, folder, shouting)
    counters = chunks.read_counters(spark, folder).collect()
    assert len(counters) == len({r.chunk for r in counters}) == 48 and all((r.processed, r.errors, r.calls, r.attempt) == (1, 0, 1, 0) for r in counters)
    assert chunks.read_outcomes(spark, folder).count() == 48 == chunks.read_summaries(spark, folder).distinct().count()
    # 48 chunks were 48 batches once
    assert len(list((pathlib.Path(folder) / "chunks" / "commits").glob("[0-9]*"))) <= 2


def failing_on_some():
    def call(texts):
        if texts[0] in ("text 20", "text 21", "text 22"):
            raise ConnectionError("away")
        return shout(texts)

    return call


def test_a_wave_that_is_stopped_leaves_its_other_chunks_done(spark, arrivals):
    papers, _, folder = arrivals
    chunks.land_papers(papers, folder, 3)
    assert not chunks.run_chunks(spark, folder, failing_on_some, policy(max_failures=1, attempts=1))
    assert chunks.run_chunks(spark, folder, shouting)
    done = chunks.read_outcomes(spark, folder).where("status = 'done'")
    assert done.count() == done.select("paper_id").distinct().count() == 48 and done.where("attempt = 0").count() > 3
    counters = chunks.read_counters(spark, folder).agg(F.sum("processed"), F.sum("errors"), F.sum("skipped")).first()
    by_status = {r["status"]: r["count"] for r in chunks.read_outcomes(spark, folder).groupBy("status").count().collect()}
    assert tuple(counters) == (48, by_status["failed"], by_status.get("skipped", 0))
