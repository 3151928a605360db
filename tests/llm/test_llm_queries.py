"""The queries of the package against their SQL on the smallest tables, and what they register."""

import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from topicflow.session import lasting_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in "documents pages benchmark labels".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_against_sql(spark, database, name):
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    frame = entry.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in frame.select(*names).collect()) == expected


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_native_plan_of_mixing(spark):
    plan = entry.queries()["op2_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD", "CartesianProduct", "NestedLoop"))


def test_language_held_out_accuracy(spark):
    found = entry.queries()["op4_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").selectExpr("lang = lang_pred AS ok", "score").collect()
    assert len(rows) > 200 and sum(r["ok"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_second_run_encodes_nothing(spark):
    count = entry.queries()["op1_token_counts"]
    before = sorted(tuple(r) for r in count(spark, SF).collect())
    cache = spark.read.parquet(lasting_dir(spark, "token-cache"))
    stored = cache.count()
    assert sorted(tuple(r) for r in count(spark, SF).collect()) == before
    assert spark.read.parquet(lasting_dir(spark, "token-cache")).count() == stored >= len({r[0] for r in before}) / 2


def plain_language(rows, held_out, ranks=300):
    """Rank-order profiles by their definition, on strings."""

    def grams(text):
        letters = "".join(c if c.isalpha() and (c.isascii() or c >= "\u00c0") else " " for c in text.lower())
        spaced = " " + " ".join(letters.split()) + " "
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(spaced) - n + 1):
                gram = spaced[i : i + n]
                if gram[: max(1, n - 1)].strip():
                    found[gram.lstrip(" ")] += 1  # the start of a word counts with the rest of its occurrences
        return found

    order = lambda counts: sorted(counts, key=lambda g: (-counts[g], tuple(0 if c == " " else ord(c) + 1 for c in g.rjust(3, "\0"))))[:ranks]
    totals = {}
    for i, text, lang in rows:
        if not held_out(i) and lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(order(counts))} for lang, counts in totals.items()}
    out = {}
    for i, text, _ in rows:
        own = order(grams(text or ""))
        apart = {lang: sum(abs(p[g] - r) if g in p else ranks for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        out[i] = (best, 1 - apart[best] / (ranks * len(own))) if own else ("und", 0.0)
    return out


def test_language_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = plain_language(rows, lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    found = {r.doc_id: (r.lang_pred, r.score) for r in entry.queries()["op4_language"](spark, SF).collect()}
    assert {i: p for i, (p, _) in found.items()} == {i: p for i, (p, _) in expected.items()}
    assert all(abs(found[i][1] - expected[i][1]) < 1e-9 for i in found)
