"""The Merkle manifest against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from topicflow.llm import merkle


def row_leaf(row, lower=False):
    """SHA-256 of a document's fields, by the letter."""
    doc_id, source, lang, n_chars, text = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return hashlib.sha256("".join(parts).encode()).digest()


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def run(spark, rows, folder):
    docs = spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING, tree STRING, key INT, leaf BINARY")
    change = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(merkle.document_leaves(docs, change), f"file://{folder}").collect()
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return found


def expected(rows):
    return merkle.brute_force([(r[1], r[0], row_leaf(r), row_leaf(r, True) if tampered(r[0]) else None) for r in rows])


def columns(found):
    return sorted(map(repr, ((r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in found)))


def many_rows():
    rng = random.Random(6)
    sizes = {None: 3, "": 1, "b": 17, "a": 300, "É": 16, "z" * 40: 5}
    rows = [(i, s, rng.choice([None, "en"]), rng.choice([None, 7]), rng.choice([None, "", "ÀB cd", f"Text {i}"])) for s, n in sizes.items() for i in rng.sample(range(10**9), n)]
    rows += [rows[40], rows[40], (rows[40][0], "a", "fr", None, "other text of the same id"), (None, "a", None, None, None), (None, "b", None, 1, "x")]
    rng.shuffle(rows)
    return rows


def test_proofs_and_versions(spark, tmp_path):
    rows = many_rows()
    found = run(spark, rows, tmp_path)
    assert columns(found) == sorted(map(repr, expected(rows)))
    # a change that alters nothing still verifies, others do not; a version's last node is its root
    altered = [r for r in found if r.copied is not None and r.folded_root != r.root]
    assert altered and any(r.copied is not None and r.verified for r in found)
    assert all(r.verified for r in found if r.copied is None) and all(r.copied[-1] == r.folded_root for r in altered)


@pytest.mark.parametrize("run_size, levels", [(16, 1), (16, 2)])
def test_several_rounds(spark, tmp_path, monkeypatch, run_size, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", run_size**levels)
    rows = many_rows() + [(i, f"s{i}", None, None, None) for i in range(40)] + [(i, "full", "x", i, "T") for i in range(256)]
    assert columns(run(spark, rows, tmp_path)) == sorted(map(repr, expected(rows)))


def test_one_block_exactly(spark, tmp_path):
    rows = [(i, "s", None, None, None) for i in range(merkle.BLOCK)] + [(i, "t", None, None, "T") for i in range(merkle.BLOCK + 1)]
    assert columns(run(spark, rows, tmp_path)) == sorted(map(repr, expected(rows)))


def test_one_leaf_and_none(spark, tmp_path):
    assert columns(run(spark, [(1, None, "en", 2, "A" * 100_000)], tmp_path / "a")) == sorted(map(repr, expected([(1, None, "en", 2, "A" * 100_000)])))
    assert run(spark, [], tmp_path / "b") == []
