"""Spelling variants against brute force."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from topicflow.llm import spelling

SCHEMA = "doc_id LONG, text STRING, word STRING, n INT, block BINARY, host BOOLEAN"


def run(spark, rows, folder, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, b"", True) for i, t in rows], SCHEMA)
    found = spelling.spelling_variants(docs, f"file://{folder}", **options).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def some_rows(seed=1):
    rng = random.Random(seed)
    words = ["theory", "Théorie", "graphs", "network", "ÀÉÎõü", "straße", "aabbc", "abcab", "x" * 40, "ab" * 3]
    rows = []
    for i in range(250):
        text = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(words)
            if rng.random() < 0.35:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé×") + w[at:], w[:at] + rng.choice("xyzÿ") + w[at + 1 :]])
            text.append(w.upper() if w.isascii() and rng.random() < 0.1 else w)
        rows.append((None if i % 50 == 3 else i // 2 if i % 9 == 0 else i, rng.choice([" ", "1", "\n", "日", "_"]).join(text)))
    return rows + [(300, None), (301, ""), (302, "1234 ,. 日本")] + rows[:4]


def test_variants(spark, tmp_path):
    rows = some_rows()
    expected = spelling.brute_force(rows)
    assert run(spark, rows, tmp_path) == expected
    assert sum(v[0] is not None for v in expected.values()) > 20


@pytest.mark.parametrize("options", [{"tile_words": 2, "block_words": 10_000}, {"tile_words": 7, "block_words": 40}, {"block_words": 1}])
def test_wide_blocks_are_tiled(spark, tmp_path, options):
    rows = some_rows(2)
    assert run(spark, rows, tmp_path, **options) == spelling.brute_force(rows)


def test_chains_and_ties(spark, tmp_path):
    # aaaab and aaaac are as frequent, and two steps lead from aaaaabb to the root
    counts = {"aaaaabb": 3, "aaaaab": 7, "aaaab": 20, "aaaac": 20, "aaaad": 5, "bbbbb": 3, "abcdefg": 4, "gfedcba": 9}
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(counts.items(), 1000)]
    rows = [(i, t) for i, t in rows if len(spelling.brute_force([(i, t)])) == 1]
    found = run(spark, rows, tmp_path)
    assert found == spelling.brute_force(rows)
    assert found["aaaad"][0] == "aaaab" and found["aaaaabb"][:2] == ("aaaaab", "aaaab") and found["gfedcba"][3] == 0


def test_very_long_texts_and_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 10)
    long_run = "abcde" * 500
    rows = [(1, f"{long_run} {long_run[:-1]} " * 3 + "words and letters " * 90_000), (2, "lettars " * 5), (3, None)]
    assert run(spark, rows, tmp_path) == spelling.brute_force(rows)


def test_no_words(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == {}
    assert run(spark, [(1, "one two"), (2, None)], tmp_path / "b") == {}


def test_one_edit():
    pairs = [(b"abcde", b"abcde"), (b"abcde", b"abxde"), (b"abcde", b"abcd"), (b"bcde", b"abcde"), (b"abcde", b"bacde"), (b"aab", b"aaab"), (b"abc", b"abcde")]
    x, y = (spelling.Words.of([p[side] for p in pairs]) for side in (0, 1))
    at = np.arange(len(pairs))
    assert spelling.one_edit(x, at, y, at).tolist() == [False, True, True, True, False, True, False]
    assert (spelling.letter_groups(np.ones(90), 10**9) < 16).all()


def test_blocks_an_edit_leads_to():
    group = spelling.letter_groups(np.ones(90), 10**4, 100)
    into = np.eye(int(group.max()) + 1, dtype=np.int64)[group]
    block = lambda w: spelling.block_of((spelling.letter_counts(spelling.Words.of([w])) @ into)[0])
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choices(spelling.LETTERS, k=rng.randint(2, 9)))
        at = rng.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + bytes([rng.choice(spelling.LETTERS)]) + word[at + 1 :]):
            one, two = block(word), block(other)
            met = (one == two) + list(spelling.neighbours(one)).count(two) + list(spelling.neighbours(two)).count(one)
            assert met == 1


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = entry.queries()["op11_spelling_variants"](spark, sf).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == spelling.brute_force(rows)
