"""Line removal against brute force."""

import random

import pytest

from topicflow.llm import lines

SCHEMA = "doc_id LONG, text STRING, pos STRING, h1 INT, word BINARY, keep_bits INT"


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"The quick brown fox jumps over {i}" for i in range(12)]
    pool += ["Éa short", "  padded line that is LONG enough \t", "", "ÀÉ line with accents and UPPER case", "exactly twenty chars", "only nineteen chars"]
    rows = []
    for i in range(200):
        n = rng.randint(0, 200 if i % 50 == 0 else 6)
        own = [rng.choice(pool) if rng.random() < 0.8 else f"a line of its own, number {rng.randint(0, 10**6)}" for _ in range(n)]
        own = [line.upper() if rng.random() < 0.1 and line.isascii() else line for line in own]
        doc_id = None if i % 40 == 7 else i // 2 if i % 10 == 0 else i
        rows.append((doc_id, "\n".join(own) if own else (None if i % 2 else "")))
    return rows + rows[:5]


def run(spark, rows, folder, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, b"", 2) for i, t in rows], SCHEMA)
    out = lines.without_repeated_lines(docs, lines.repeated_lines(docs, f"file://{folder}", **options)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out)


def expected(rows, **options):
    return sorted((-1 if i is None else i, *cut) for (i, _), cut in zip(rows, lines.brute_force(rows, **options)))


@pytest.mark.parametrize("light_rows", [1, 5, 256])
def test_lines_that_many_documents_hold(spark, tmp_path, monkeypatch, light_rows):
    monkeypatch.setattr(lines, "LIGHT_ROWS", light_rows)  # every hash heavy, some, none
    rows = rows_of(4)
    assert run(spark, rows, tmp_path) == expected(rows)
    assert sum(r[2] for r in expected(rows)) > 100


def test_other_limits_and_a_very_long_text(spark, tmp_path):
    rows = rows_of(5) + [(1000, "\n".join(f"line of a very long text {i % 3000}" for i in range(40_000))), (999, "line of a very long text 7\n" * 3)]
    assert run(spark, rows, tmp_path / "a", least_chars=5, least_docs=2) == expected(rows, least_chars=5, least_docs=2)
    assert run(spark, rows, tmp_path / "b", least_docs=10) == expected(rows, least_docs=10)


def test_bitmaps_tell_lines_that_stay(spark, tmp_path):
    repeated = "a line that all documents hold"
    rows = [(1, "\n".join(["x"] * 70 + [repeated])), (2, f"{repeated}\ny"), (3, repeated), (4, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = {r.doc_id: (r.n_dropped, r.keep_bits) for r in lines.repeated_lines(docs, f"file://{tmp_path}").collect()}
    assert found == {1: (1, {1: ~(1 << 6)}), 2: (1, {0: ~1})}


def test_no_documents(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_plan_is_native(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(6), "doc_id LONG, text STRING")
    plan = lines.without_repeated_lines(docs, lines.repeated_lines(docs, f"file://{tmp_path}"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
