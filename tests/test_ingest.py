import json

import pytest
from pyspark.sql import functions as F

from topicflow.functions import notes as N
from topicflow.operators import audit, ingest
from topicflow.sources import notes as S, papers as P

NOTES = {
    "neurips2021": [
        {"id": "a", "forum": "a", "number": 1, "decision": "Accept", "content": {
            "title": "T\nitle", "abstract": "Abs", "TL;DR": "", "tl;dr": "short", "authors": ["A", "B"],
            "keywords": ["x", 3], "venue": "NeurIPS "}},
        {"id": "b", "forum": "b", "number": 2, "decision": None, "content": {"title": "U", "abstract": ""}},
    ],
    "iclr": [
        {"id": "c", "forum": "c", "number": 1, "content": {
            "title": {"value": "V"}, "abstract": {"value": "W"}, "TLDR": {"value": "t"}, "authors": {"value": ["C"]},
            "keywords": {"value": "y"}, "venue": {"value": ""}}},
        {"id": "d", "forum": "d", "number": 2, "content": {"title": {"value": None}, "abstract": {"value": "W"}}},
    ],
}


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    for conference, rows in NOTES.items():
        (root / conference).mkdir()
        (root / conference / f"{conference}_notes_with_decisions.json").write_text(json.dumps(rows))
    return S.read_note_arrays(spark, str(root))


def test_flatten(notes):
    flat = {r["paper_id"]: r for r in ingest.flatten_notes(notes).collect()}
    a, c = flat["a"], flat["c"]
    assert (a["conference"], a["title"], a["tldr"], a["authors"], a["keywords"], a["venue"]) == (
        "neurips2021", "Title", "short", ["A", "B"], ["x"], "NeurIPS ")
    assert (a["decision"], a["has_decision"], flat["b"]["decision"], flat["b"]["has_decision"]) == ("Accept", True, None, True)
    assert (c["conference"], c["title"], c["tldr"], c["authors"], c["keywords"], c["venue"], c["has_decision"]) == (
        "iclr", "V", "t", ["C"], [], "", False)
    assert flat["d"]["title"] == ""


def test_required_fields_and_load(notes):
    kept = ingest.with_required_fields(ingest.flatten_notes(notes))
    accepted, rejected = ingest.split_rejects(ingest.to_collection(kept))
    assert [(r["paper_id"], r["year"], r["venue"]) for r in accepted.collect()] == [("a", 2021, "NeurIPS ")]
    assert [(r["paper_id"], r["year"], r["venue"]) for r in rejected.collect()] == [("c", None, "")]


def test_line_layout_round_trip(spark, notes, tmp_path):
    path = str(tmp_path / "lines")
    S.write_note_lines(notes, path)
    back = S.read_note_lines(spark, path)
    columns = ["conference", "paper_id", "title", "abstract", "tldr", "venue", "keywords"]
    rows = lambda df: sorted(ingest.flatten_notes(df).select(*columns).collect(), key=lambda r: r["paper_id"])
    assert rows(back) == rows(notes)


@pytest.mark.parametrize(
    ("content", "key", "expected"),
    [
        ({"title": {"value": "B"}}, "title", "B"),
        ({"title": "A"}, "title", "A"),
        ({}, "title", ""),
        ({"TL;DR": "", "tl;dr": "x"}, "TL;DR", "x"),
        ({"TL;DR": {}, "tl;dr": "x"}, "TL;DR", "x"),
        ({"TL;DR": {"value": ""}, "tl;dr": "x"}, "TL;DR", ""),
        ({"TL;DR": 0, "tl;dr": "x"}, "TL;DR", "x"),
        ({"title": {"value": None}}, "title", ""),
        ({"title": {"value": {"deep": 1}}}, "title", ""),
        ({"title": 7}, "title", ""),
    ],
)
def test_text_field(spark, content, key, expected):
    df = spark.createDataFrame([(json.dumps(content),)], "j STRING").select(F.parse_json("j").alias("c"))
    assert df.select(N.text_field(F.col("c"), key, key.lower())).first()[0] == expected


@pytest.mark.parametrize(
    ("value", "expected"), [(["x", 3], ["x"]), ({"value": ["y"]}, ["y"]), ({"value": "y"}, []), ("z", []), (None, [])]
)
def test_string_list(spark, value, expected):
    df = spark.createDataFrame([(json.dumps({"keywords": value}),)], "j STRING").select(F.parse_json("j").alias("c"))
    assert df.select(N.string_list(F.col("c"), "keywords")).first()[0] == expected


def test_merge_decisions(spark):
    submissions = spark.createDataFrame([("p1", "f1"), ("p2", "f2"), ("p3", "f3")], "paper_id STRING, forum STRING")
    notes = spark.createDataFrame(
        [("f1", "late", 2, 1), ("f1", "first", 1, 1), ("f2", None, 1, 1), ("f1", "later paper", 1, 2)],
        "forum STRING, decision STRING, note_order INT, paper_order INT",
    )
    plain = ingest.merge_decisions(submissions, notes.where("paper_order = 1").drop("paper_order"))
    assert {r["paper_id"]: r["decision"] for r in plain.collect()} == {"p1": "first", "p2": "", "p3": None}
    last = ingest.merge_decisions(submissions, notes)
    assert {r["paper_id"]: r["decision"] for r in last.collect()} == {"p1": "later paper", "p2": "", "p3": None}


def test_audits(notes):
    flat = ingest.flatten_notes(notes)
    coverage = {r["conference"]: r for r in audit.decision_coverage(flat).collect()}
    assert coverage["neurips2021"]["percentage"] == 50.0 and coverage["neurips2021"]["decisions_available"]
    assert coverage["iclr"]["with_decision"] == 0 and not coverage["iclr"]["decisions_available"]
    missing = {r["conference"]: r for r in audit.missing_fields(flat).collect()}
    assert (missing["iclr"]["missing_title"], missing["neurips2021"]["missing_abstract"]) == (1, 1)
    venues = [(r["conference"], r["venue"], r["papers"]) for r in audit.venue_histogram(flat).collect()]
    assert venues == [("iclr", audit.EMPTY_VENUE, 2), ("neurips2021", "neurips ", 1), ("neurips2021", audit.EMPTY_VENUE, 1)]
    profile = {(r["conference"], r["key"]): r for r in audit.schema_profile(notes).collect()}
    assert profile["neurips2021", "title"]["notes"] == 2 and profile["iclr", "title"]["value_type"].startswith("OBJECT")


def test_summary_coverage(papers):
    row = audit.summary_coverage(papers).first()
    assert (row["total"], row["with_summary"], row["without_summary"], row["without_abstract"]) == (9, 2, 5, 2)
    assert [r["paper_id"] for r in audit.summary_samples(papers).collect()] == ["p1", "p2", "p3", "p4", "p5"]


def test_collection_storage(spark, papers, tmp_path):
    path = str(tmp_path / "papers")
    P.write_collection(papers, path)
    stored = P.read_collection(spark, path)
    assert stored.count() == 9
    plan = P.papers_of_year(stored, 2023)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert sorted(r["paper_id"] for r in P.papers_of_year(stored, 2023, limit=2).collect()) == ["p3", "p4"]
    assert P.papers_of_year(stored, None).count() == 9
    clean = papers.select(F.lit("c2022").alias("conference"), "paper_id", "title", "abstract")
    P.write_clean(clean, str(tmp_path / "clean"))
    assert P.read_clean(spark, str(tmp_path / "clean")).where("conference = 'c2022'").count() == 9


def test_years(papers):
    ids = lambda df: sorted(r["paper_id"] for r in df.collect())
    assert ids(P.papers_of_years(papers, [2022, 2023, 2022])) == ["p1", "p1", "p2", "p2", "p3", "p4", "p5"]
    assert ids(P.papers_of_years(papers, [2022, 2023], limit_per_year=1)) == ["p1", "p3"]


def test_summary_log(spark, papers):
    log = spark.createDataFrame(
        [("p1", "old", 1), ("p1", "new", 2), ("p1", "", 3), ("p4", None, 1), ("p3", "newer", 1)],
        "paper_id STRING, summary STRING, ts INT",
    )
    got = {r["paper_id"]: r["summary"] for r in P.apply_summaries(papers, log).collect()}
    assert (got["p1"], got["p3"], got["p4"], got["p6"]) == ("new", "newer", None, "speech")
    assert "summary" in P.with_summary_column(papers.drop("summary")).columns
