"""Large JSON arrays cut in ranges, against the parser of the standard library."""

import json
import random

import pytest

from topicflow.sources.arrays import _range_bytes, read_json_elements, write_json_arrays
from topicflow.sources.notes import read_note_arrays, read_split_note_arrays


@pytest.fixture
def small_ranges(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def value(rng, depth=0):
    strings = ["", "plain", 'a "quoted" word', "back\\slash", "\\\\", '\\"', "{not [a} start]", "}}}{{{", "], [", "naïve 日本", "line\nbreak", "x" * rng.randint(0, 400)]
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind < 2:
        return rng.choice(strings)
    if kind < 4:
        return rng.choice([None, True, 12, -3.5])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(strings): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def elements_of(session, path):
    return sorted(json.dumps(json.loads(r["element"]), sort_keys=True) for r in read_json_elements(session, path).collect())


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_elements(small_ranges, tmp_path, layout):
    rng = random.Random(3)
    files = {"a": 60, "b": 1, "c": 0, "d": 7}
    expected = []
    for name, n in files.items():
        array = [{"id": f"{name}{i}", "v": value(rng), "}": {"w": value(rng)}} for i in range(n)]
        expected += [json.dumps(e, sort_keys=True) for e in array]
        (tmp_path / f"{name}.json").write_text(json.dumps(array, **layout) + "\n" * (n % 2), encoding="utf-8")
    assert read_json_elements(small_ranges, str(tmp_path)).rdd.getNumPartitions() >= 2
    assert small_ranges.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 10
    assert elements_of(small_ranges, str(tmp_path)) == sorted(expected)


def test_elements_larger_than_ranges(small_ranges, tmp_path):
    array = [{"i": i, "text": "word } { \" " * (400 if i % 3 == 0 else 1), "more": {"x": ["y"] * 200}} for i in range(12)]
    (tmp_path / "a.json").write_text(json.dumps(array))
    assert elements_of(small_ranges, str(tmp_path)) == sorted(json.dumps(e, sort_keys=True) for e in array)


def test_empty_elements(small_ranges, tmp_path):
    (tmp_path / "a.json").write_text("[{}, {},\n{}]")
    (tmp_path / "b.json").write_text(" [ ] ")
    assert [r["element"] for r in read_json_elements(small_ranges, str(tmp_path)).collect()] == ["{}"] * 3


def test_round_trip(spark, small_ranges, tmp_path):
    rows = [(json.dumps({"id": i, "t": f"text {i}"}),) for i in range(100)] + [(None,)]
    write_json_arrays(spark.createDataFrame(rows, "element STRING").repartition(3), str(tmp_path / "w"))
    write_json_arrays(spark.createDataFrame([], "element STRING").coalesce(1), str(tmp_path / "none"))
    assert elements_of(small_ranges, str(tmp_path / "w")) == sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in rows if r[0])
    assert elements_of(small_ranges, str(tmp_path / "none")) == []


def test_notes_equal_the_unsplit_reader(spark, small_ranges, tmp_path):
    rng = random.Random(5)
    for venue in ("X_2023", "Y_2024"):
        (tmp_path / venue).mkdir()
        notes = [{"id": f"{venue}{i}", "forum": "f", "number": i, "content": {"title": value(rng)}, **({"decision": "Accept"} if i % 2 else {})} for i in range(30)]
        (tmp_path / venue / f"{venue}_notes_with_decisions.json").write_text(json.dumps(notes))
    rows = lambda df: sorted((r.conference, r.id, r.number, r.content and r.content.toJson(), r.decision and r.decision.toJson()) for r in df.collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(read_split_note_arrays(small_ranges, str(tmp_path))), key=key) == sorted(rows(read_note_arrays(spark, str(tmp_path))), key=key)


def test_small_ranges_share_tasks(small_ranges, tmp_path):
    expected = [{"id": i, "text": "}{[\\\"" * (i % 40)} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(expected))
    assert small_ranges.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
    elements = read_json_elements(small_ranges, str(tmp_path))
    plan = elements.where("element is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 16, false" in plan
    assert elements_of(small_ranges, str(tmp_path)) == sorted(json.dumps(x, sort_keys=True) for x in expected)


@pytest.mark.parametrize("size, expected", [("300b", 300), ("262144", 262144), ("128MB", 128 << 20), ("1k", 1024), ("134217728b", 1 << 27)])
def test_sizes_as_spark_writes_them(spark, size, expected):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert _range_bytes(session) == expected
