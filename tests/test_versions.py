"""The versioned collection."""

import pytest

from topicflow.sources import papers as C, versions as V


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"p{i}", 2020 + i % 4, f"text {i}", "old" if i % 3 == 0 else None) for i in range(40)]
    papers = spark.createDataFrame(rows, "paper_id STRING, year INT, abstract STRING, summary STRING")
    V.create_versioned(papers, str(tmp_path / "c"))
    return papers, str(tmp_path / "c")


def rows_of(frame):
    return sorted(map(repr, frame.select("paper_id", "year", "abstract", "summary").collect()))


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "paper_id STRING, summary STRING, ts INT")


def test_folds_equal_the_joined_log(spark, stored):
    papers, path = stored
    first = log(spark, ("p0", "a", 1), ("p0", "b", 2), ("p4", "c", 1), ("p99", "x", 1), ("p8", "", 3))
    second = log(spark, ("p0", "d", 5), ("p1", "e", 5), ("p2", None, 6))
    assert rows_of(V.read_versioned(spark, path)) == rows_of(papers)
    assert V.fold_summaries(spark, path, first, "one")
    assert rows_of(V.read_versioned(spark, path)) == rows_of(C.apply_summaries(papers, first))
    assert V.fold_summaries(spark, path, second, "two")
    whole = rows_of(C.apply_summaries(papers, first.union(second)))
    assert rows_of(V.read_versioned(spark, path)) == whole
    # a replayed fold changes nothing, earlier versions can still be read
    assert not V.fold_summaries(spark, path, first, "one")
    assert rows_of(V.read_versioned(spark, path)) == whole
    assert rows_of(V.read_versioned(spark, path, 0)) == rows_of(papers)
    assert sorted(tuple(r) for r in V.versions(spark, path).collect()) == [(0, "", 4), (1, "one", 1), (2, "two", 2)]


def test_reads_join_nothing_and_skip_years(spark, stored):
    _, path = stored
    V.fold_summaries(spark, path, log(spark, ("p1", "new", 1)), "one")
    found = V.read_versioned(spark, path, years=[2021])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.year for r in found.collect()} == {2021} and all("held=1/year=2021" in f for f in found.inputFiles())
    assert found.where("paper_id = 'p1'").first().summary == "new"


def test_a_fold_that_was_lost_is_tried_again(spark, stored):
    papers, path = stored
    part = log(spark, ("p2", "new", 1))
    papers.limit(3).write.partitionBy("year").parquet(f"{path}/years/held=1")  # data without a list
    assert rows_of(V.read_versioned(spark, path)) == rows_of(papers)
    assert V.fold_summaries(spark, path, part, "one")
    assert rows_of(V.read_versioned(spark, path)) == rows_of(C.apply_summaries(papers, part))


def test_a_log_that_touches_nothing(spark, stored):
    papers, path = stored
    assert V.fold_summaries(spark, path, log(spark, ("none", "x", 1)), "one")
    assert not V.fold_summaries(spark, path, log(spark, ("p1", "x", 1)), "one")
    assert rows_of(V.read_versioned(spark, path)) == rows_of(papers)


def test_no_papers(spark, stored, tmp_path):
    papers, _ = stored
    path = str(tmp_path / "none")
    V.create_versioned(papers.where("false"), path)
    assert V.fold_summaries(spark, path, log(spark, ("p1", "x", 1)), "one")
