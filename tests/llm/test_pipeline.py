"""The pipeline's stages against brute force on a small slice of documents made for the purpose."""

import random

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import plain_least_squares
from topicflow.llm import decontaminate, jaccard, mixing, suffixes
from topicflow.llm.oracle import ORACLE_SQL
from topicflow.llm.queries import domains_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert set(out.columns) >= set(docs.columns) if at == len(corpus_pipeline.STAGES) - 1 else out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in jaccard.brute_force(before).items() if i == c}
        if name == "suffix_dedup":
            expected = suffixes.brute_force(before)
            assert set(after) == {i for i, (n, gone, _, _) in expected.items() if gone < n or not n}
            whole = dict(before)
            assert all(after[i] == whole[i] for i in after if expected[i][1] == 0)
        if name == "mixing":
            assert kept.where("mix_rate <= 0").count() == 0
        docs = kept
    assert 0 < docs.count() < 200


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "mixing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_of_edge_rows(spark):
    rng = random.Random(1)
    good = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(i) for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)]
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(rows, schema)
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, schema), SF)
    assert kept.where("doc_id = 1").count() == 1
    assert corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(rows, schema).limit(0), SF).count() == 0
    assert kept.where(F.col("doc_id").isNull()).count() == 2


def test_quality_stage_against_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in database.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op6_quality']}) WHERE kept").fetchall()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, SF).collect()} == good and 0 < len(good) < 200


def test_decontamination_stage_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(2)
    texts = [(i, t) for i, t in ((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()) if len(t) < 1500][:60]
    for i, (_, item) in enumerate(items[:8]):
        words = item.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edited"
        texts.append((1000 + i, " ".join(["before", *words, "after"])))
    docs = spark.createDataFrame([(i, "en", t) for i, t in texts], "doc_id LONG, lang STRING, text STRING")
    leaked = {i for i, _ in decontaminate.brute_force(texts, items)}
    kept = corpus_pipeline.without_benchmark(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - leaked
    assert {1000, 1004} <= leaked


def test_mixing_stage_against_a_plain_solver(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/m"
    rows = mixing.mixing_rates(docs, domains_of(spark, SF), corpus_pipeline.TARGETS, folder).collect()
    fit = sorted(spark.read.parquet(f"{folder}/fit").collect(), key=lambda r: r.domain)
    tokens = np.array([r.n_tokens for r in rows], float)
    totals = (np.array([[r[f"p_{f.domain}"] for f in fit] for r in rows]) * (tokens / tokens.sum())[:, None]).T
    targets = np.array([f.target for f in fit])
    distance = np.linalg.norm(totals @ np.array([r.mix_rate for r in rows]) - targets)
    assert distance <= plain_least_squares(totals, targets) + 1e-3
    kept = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.mix_rate > 0}


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, c), (1, a), (3, b + " end"), (4, None), (4, None), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, a), (1, b), (2, c), (4, None), (None, a), (None, a)]))


def test_columns_of_any_name(spark):
    names = ["kept_id", "turn", "kept", "n_bytes", "n_removed", "n_tokens", "block", "own_key", "column_1", "text_key", "mix_rate"]
    rng = random.Random(1)
    words = [f"{w}{i}" for w in "alpha beta gamma delta".split() for i in range(50)]
    rows = [(i, " ".join(rng.sample(words, 60)), *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, " + ", ".join(f"{n} STRING" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(rows)
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert set(names) <= set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    assert {r.kept_id for r in mixed.collect()} <= {f"kept_id{i}" for i in range(6)}
