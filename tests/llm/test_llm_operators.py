"""Each operator against brute force on small rows, and in its edge cases."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from topicflow.llm import (
    blocks, components, decontaminate, jaccard, language, mixing, quality, repeats, suffixes, token_counts, url_rules, warc,
)
from topicflow.llm.common import window_hashes, word_bounds, word_hashes

#: Columns whose names the operators use inside.
CLASHING = "doc_id LONG, text STRING, block STRING, measured INT, phase STRING, part STRING, bits BINARY"


def frame(spark, texts, first_id=0, step=1):
    rows = [(None if i is None else i, t, "x", 1, "y", "z", b"b") for i, t in zip(range(first_id, 10**9, step), texts)]
    return spark.createDataFrame(rows, CLASHING)


def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    source = [rng.choice(words) for _ in range(300)]
    out = [None, "", " \n\t", "one", "same text as below " * 9, "same text as below " * 9]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 250)
            text += source[at : at + rng.randint(20, 60)] + [rng.choice(words)]
        out.append(("é " * 5 if i % 6 == 0 else "") + " ".join(["again"] * rng.randint(0, 60) * (i % 7 == 0) + text))
    out.append(" ".join(f"long{i}" for i in range(60_000)) + " " + out[10])
    return out


# fingerprints


def test_word_hashes_follow_words():
    data = np.frombuffer("ab  cd\x0bab é ab".encode(), np.uint8)
    starts, ends = word_bounds(data)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == "ab  cd\x0bab é ab".encode().split()
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    windows = window_hashes(np.concatenate([h, h]), 5, np.uint64(7))
    assert windows[0] == windows[5] and len(set(windows.tolist())) == 5


# 1 token counts


def encoder():
    return token_counts.encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_both_encoders_agree_on_every_plain_character():
    whole = encoder()
    fast = token_counts.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x250) if token_counts.PLAIN.fullmatch(chr(c))]
    samples = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(400)]
    samples += [f"a{c}b {c} {c}{c}" for c in letters]
    samples += ["x<|endoftext|>y", "he's  we'll\n\n 12a", "", " ", "\n \n", "a" * 3000, "日本語 text", "tab\tand\rreturn"]
    assert fast(samples) == whole(samples)


def test_token_counts(spark, texts, tmp_path):
    docs = frame(spark, texts)
    count = lambda: token_counts.count_tokens(
        docs, f"file://{tmp_path}/cache", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    got = {r.doc_id: r for r in count().collect()}
    expected = encoder()([t or "" for t in texts])
    assert [got[i].n_tokens for i in range(len(texts))] == expected
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[i].over_limit for i in range(len(texts))] == [n > 1024 for n in expected]
    cache = spark.read.parquet(f"file://{tmp_path}/cache")
    assert cache.count() == len({t or "" for t in texts})
    assert count().count() == len(texts) and spark.read.parquet(f"file://{tmp_path}/cache").count() == cache.count()


def test_token_counts_of_nothing(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(empty(spark), f"file://{tmp_path}/c", path).count() == 0


def test_a_new_tokenizer_is_a_miss(spark):
    docs = frame(spark, ["a", "a", "b", None]).select("doc_id", "text", token_counts.content_digest("text").alias("content"))
    cache = docs.where("doc_id = 0").select(F.lit(b"v1").alias("tokenizer"), "content", F.lit(1).cast("long").alias("n_tokens"))
    assert {r.text for r in token_counts.distinct_misses(docs, cache, b"v1").collect()} == {"b", None}
    assert token_counts.distinct_misses(docs, cache, b"v2").count() == 3


# 2 mixing


def test_mixing_meets_targets(spark, tmp_path):
    rng = random.Random(2)
    kinds = {"a": ["apple", "amber"], "b": ["birch", "bread"]}
    rows = [(i, k, " ".join(rng.choices(kinds[k] + ["the", "of"], k=30))) for i in range(300) for k in ["a" if i % 3 else "b"]]
    docs = spark.createDataFrame([(i, t, 1) for i, _, t in rows] + [(900, None, 1), (901, "", 1), (0, rows[0][2], 1)], "doc_id LONG, text STRING, copies INT")
    labelled = spark.createDataFrame([(t, k) for _, k, t in rows] + [("x", None)], "text STRING, domain STRING")
    mixed = mixing.mixing_rates(docs, labelled, {"a": 0.4, "b": 0.6}, f"file://{tmp_path}/m").collect()
    assert len(mixed) == 303 and all(r.mix_rate >= 0 and abs(r.p_a + r.p_b - 1) < 1e-9 for r in mixed)
    total = sum(r.n_tokens for r in mixed)
    assert abs(sum(r.mix_rate * r.n_tokens * r.p_b for r in mixed) / total - 0.6) < 1e-3
    assert {r.n_tokens for r in mixed if r.doc_id >= 900} == {0}
    fit = {r.domain: r for r in spark.read.parquet(f"file://{tmp_path}/m/fit").collect()}
    assert abs(fit["b"].reached - 0.6) < 1e-3 and (fit["a"].weight, round(fit["a"].target, 6)) == (0.4, 0.4)


def plain_least_squares(totals, targets, rounds=30_000):
    """Distance of nonnegative least squares, by accelerated projected gradients over all rates."""
    rate = ahead = np.ones(totals.shape[1])
    step, k = 1 / np.linalg.norm(totals, 2) ** 2, 1.0
    for _ in range(rounds):
        now = np.maximum(0, ahead - step * totals.T @ (totals @ ahead - targets))
        following = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead, rate, k = now + (k - 1) / following * (now - rate), now, following
    return float(np.linalg.norm(totals @ rate - targets))


@pytest.mark.parametrize("sharp, weights", [(1.0, [0.9, 0.05, 0.05]), (0.3, [0.98, 0.02, 0.0]), (4.0, [0.97, 0.03, 0.0]), (1.0, [1, 0, 0]), (2.0, [1, 1, 6])])
def test_mixing_is_least_squares(spark, sharp, weights):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([sharp, 2 * sharp, sharp], 400)
    rows = [(int(rng.integers(1, 3)), int(rng.integers(0, 500)), *map(float, row)) for row in p]
    members = spark.createDataFrame(rows, "copies LONG, n_tokens LONG, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE")
    fit = mixing.fit_rates(members, weights)
    amount = np.array([r[0] * r[1] for r in rows], float)
    totals = (p * amount[:, None] / amount.sum()).T
    rates = np.array([r[0] for r in members.select(mixing.rate_of(fit.pull)).collect()])
    assert rates.min() >= 0 and np.allclose(totals @ rates, fit.reached)
    distance = float(np.linalg.norm(totals @ rates - fit.targets))
    assert distance <= plain_least_squares(totals, fit.targets) + 1e-3
    if sharp <= 1 or weights == [0.97, 0.03, 0.0]:
        assert (rates == 0).mean() > 0.1  # the bound matters


def test_mixing_keeps_columns_that_clash_and_reads_long_texts(spark, tmp_path):
    rows = [(1, "apple amber " * 50_000, "a", 3, 4), (2, "birch bread", "b", 5, 6), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, own_id STRING, text_key INT, copies INT")
    labelled = spark.createDataFrame([("apple amber", "a"), ("birch bread", "b")] * 20, "text STRING, domain STRING")
    mixed = mixing.mixing_rates(docs, labelled, {"a": 1, "b": 1}, f"file://{tmp_path}/m")
    assert sorted(map(repr, (tuple(r)[:5] for r in mixed.collect()))) == sorted(map(repr, rows))
    assert {r.doc_id: r.n_tokens for r in mixed.collect()} == {1: 100_000, 2: 2, None: 0}


def test_mixing_without_labels_or_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id LONG, text STRING")
    none = spark.createDataFrame([], "text STRING, domain STRING")
    assert {r.mix_rate for r in mixing.mixing_rates(docs, none, {"a": 1}, f"file://{tmp_path}/x").collect()} == {1.0}
    labelled = spark.createDataFrame([("a b", "a"), ("c", "b")] * 9, "text STRING, domain STRING")
    assert mixing.mixing_rates(docs.limit(0), labelled, {"a": 1}, f"file://{tmp_path}/y").count() == 0


# 3 URL rules


def naive_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("b.org", "/x/", "block"), ("b.org", "/x/y", "allow"), ("a.b.org", "", "block"), ("com", "/de", "block")]
    hosts = ["b.org", "a.b.org", "c.a.b.org", "xb.org", "org", "de.com", "b.organic", "COM", "", "b.org."]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/yz?q=/x/", "/de/#a", "?x")]
    urls += [None, "", "no scheme", "a://b://c", "http://b.org/x/\nnew"] + ["http://a.b.org/x/"] * 30
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id LONG, url STRING, key STRING")
    table = spark.createDataFrame([*rules, ("b.org", "/x/", "allow"), (None, "/", "block"), ("org", "/", "allow")], "host STRING, path STRING, verdict STRING")
    for ranges in (1, 7):
        got = {r.page_id: r for r in url_rules.judge_urls(pages, table, ranges=ranges).collect()}
        assert len(got) == len(urls)
        for i, url in enumerate(urls):
            rest = url.partition("://")[2] if url and "://" in url else ""
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = rest[:cut].lower()
            path = rest[cut:].split("?")[0].split("#")[0]
            assert (got[i].host, got[i].path) == (host, path)
            assert (got[i].rule, got[i].verdict) == naive_rule(host, path, rules)


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id LONG, url STRING")
    rules = spark.createDataFrame([], "host STRING, path STRING, verdict STRING")
    assert [(r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, "block").collect()] == [(None, "block")]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


# 4 language


def test_language_edges(spark):
    rows = [("en", "the cat and the dog " * 5), ("de", "der hund und die katze " * 5), (None, "x"), ("en", None)]
    profiles = language.fit_profiles(spark.createDataFrame(rows, "lang STRING, text STRING"))
    assert set(profiles) == {"en", "de"}
    docs = frame(spark, ["the dog and", "die katze und der", None, "", "123 ...", "the dog and", "der " * 400_000])
    got = [(r.lang_pred, r.score) for r in language.predict_language(docs, profiles).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["en", "de", "und", "und", "und", "en", "de"] and got[0] == got[5]
    assert {r.lang_pred for r in language.predict_language(docs, {}).collect()} == {"und"}
    assert language.fit_profiles(docs.select(F.lit(None).cast("string").alias("lang"), "text")) == {}
    assert language.predict_language(empty(spark), profiles).count() == 0


def test_out_of_place_distance():
    known = language.Profiles({"x": [5, 7, 9], "y": [9, 7]})
    assert known.distances(np.array([7, 5, 11], np.uint64)).tolist() == [1 + 1 + language.RANKS, 1 + 2 * language.RANKS]


def test_counts_in_pieces_add_up(monkeypatch):
    text = "abc abd " * 50
    whole = language.count_grams(text)
    monkeypatch.setattr(language, "PIECE", 40)
    assert [x.tolist() for x in language.count_grams(text)] == [x.tolist() for x in whole]


# 5 recompression


def check_repeats(spark, texts, **options):
    cut = repeats.remove_repeats(frame(spark, texts), **options)
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == repeats.brute_force(texts, options.get("width", repeats.WIDTH))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}, {"width": 4, "block_bytes": 9000}])
def test_repeats(spark, texts, options):
    check_repeats(spark, texts, **options)


def test_repeats_of_nothing(spark):
    cut = repeats.remove_repeats(empty(spark))
    assert cut.count() == 0 and {"kept_text", "n_words", "n_removed", "block"} <= set(cut.columns)


def test_repeats_within_one_text_and_repeated_rows(spark):
    once = " ".join(f"t{i}" for i in range(40))
    check_repeats(spark, [f"{once} x {once}", " ".join(["w"] * 200), None])
    rows = spark.createDataFrame([(1, once), (1, once), (None, "a"), (None, None)], "doc_id LONG, text STRING")
    assert sorted(r.n_removed for r in repeats.remove_repeats(rows).collect()) == [0, 0, 40, 40]


def test_symbols_inside_a_window_do_not_depend_on_what_surrounds_it():
    rng = np.random.default_rng(4)
    window = rng.integers(0, 6, 35).astype(np.uint64)
    found = []
    for _ in range(30):
        before, after = (rng.integers(0, 6, n).astype(np.uint64) for n in rng.integers(0, 40, 2))
        words = np.concatenate([before, window, after])
        s = repeats.recompress(words, np.zeros(len(words), np.int64))
        at = len(before)
        inside = (s.low >= at) & (s.high <= at + 35)
        found.append([(n, l - at, h - at) for n, l, h in zip(s.names[inside].tolist(), s.low[inside], s.high[inside])])
    assert all(f == found[0] for f in found)


# 6 quality


def test_quality_measures(spark, texts):
    ledger = {r.doc_id: r for r in quality.quality_ledger(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 8)}
        assert (ledger[i].n_words, ledger[i].n_repeat_words) == (len(words), len(covered))
        assert ledger[i].word_chars == sum(len(w.decode()) for w in words)
    assert quality.quality_ledger(empty(spark)).count() == 0


def test_quality_lines_symbols_and_policies(spark):
    docs = frame(spark, ["a b\na b\n \n \nc # |", "word " * 30, None, " ".join(f"WORD{i}" for i in range(30)), "good word " * 2 + " ".join(f"plain{i}" for i in range(30))])
    ledger = quality.quality_ledger(docs).orderBy("doc_id")
    rows = ledger.collect()
    assert (rows[0].n_dup_lines, rows[0].n_symbols, rows[0].n_lines) == (1, 2, 3)
    kept = [r.k for r in ledger.select(quality.passes().alias("k")).collect()]
    assert kept == [False, False, False, False, True]
    by_rule = {r.rule: r for r in quality.ablations(ledger).collect()}
    assert by_rule["upper_case"].rejected_by_it_alone == 1 and by_rule["too_few_words"].failed == 2
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and [r.doc_id for r in good.collect()] == [4]
    assert {r.kept for r in quality.ablations(quality.quality_ledger(empty(spark))).collect()} == {0}


# 7 longest previous factors


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}, {"block_bytes": 3000, "hot_blocks": 2}, {"length": 12, "gram": 5}])
def test_later_copies(spark, texts, options):
    rows = [(500 - 7 * i, t) for i, t in enumerate(texts)]
    cut = suffixes.remove_later_copies(spark.createDataFrame(rows, "doc_id LONG, text STRING"), **options)
    names = ("n_bytes", "n_removed", "n_spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in cut.select("doc_id", *names, F.sha2("kept", 256).alias("s")).collect()}
    assert got == suffixes.brute_force(rows, options.get("length", suffixes.LENGTH))


def test_later_copies_edges(spark):
    text = "é" * 20 + "".join(chr(97 + i * i % 23) for i in range(90))
    rows = [(1, text), (1, text), (2, text), (None, None), (None, ""), (3, "a" * 200)]
    cut = suffixes.remove_later_copies(spark.createDataFrame(rows, "doc_id LONG, text STRING"), as_text=True)
    got = sorted(((r.doc_id or 0, r.n_removed, r.kept) for r in cut.collect()), key=repr)
    assert got == sorted([(0, 0, ""), (0, 0, ""), (1, 0, text), (1, 0, text), (2, 130, ""), (3, 0, "a" * 200)], key=repr)
    out = suffixes.remove_later_copies(empty(spark))
    assert out.count() == 0 and "block" in out.columns


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}])
def test_a_text_without_an_id_is_no_earlier_copy(spark, options):
    text, other = ("".join(chr(97 + (i * i * k) % 23) for i in range(90)) for k in (1, 5))
    rows = [(None, text), (None, text + other), (-(2**63), other), (4, text), (9, text), (None, None)]
    cut = suffixes.remove_later_copies(spark.createDataFrame(rows, "doc_id LONG, text STRING"), as_text=True, **options)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in cut.collect()), key=repr)
    kept = [(None, 90, 0, 0, text), (None, 180, 0, 0, text + other), (-(2**63), 90, 0, 0, other), (4, 90, 0, 0, text), (9, 90, 90, 1, ""), (None, 0, 0, 0, "")]
    assert got == sorted(kept, key=repr)


def test_previous_factors_by_definition():
    rng = np.random.default_rng(1)
    windows, docs = rng.integers(0, 2, (300, 5)).astype(np.uint8), rng.integers(0, 40, 300)
    expected = [any((windows[j] == windows[i]).all() and docs[j] < docs[i] for j in range(300)) for i in range(300)]
    assert suffixes.with_previous_factor(windows, docs).tolist() == expected


def test_ranges_of_minimizers_hold_about_equally_many():
    data = np.random.default_rng(2).integers(0, 256, 200_000).astype(np.uint8)
    *_, keys = suffixes.minimizer_runs(data, np.array([len(data)]), suffixes.LENGTH, suffixes.GRAM)
    held = np.bincount(blocks.parts_of(np.unique(keys), 40), minlength=40)
    assert held.max() < 2 * held.mean() and held.min() > held.mean() / 2


@pytest.mark.parametrize("length", [1, 2, 7, 50])
def test_bytes_that_windows_cover(length):
    starts = np.random.default_rng(length).random(400) < 0.02
    expected = [bool(starts[max(0, i - length + 1) : i + 1].any()) for i in range(400)]
    assert suffixes._covered(starts, length).tolist() == expected
    assert suffixes._covered(np.zeros(0, bool), length).tolist() == []


# 8 Jaccard join


def near_copies(rng):
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        rows.append(text)
        for _ in range(25 if i == 5 else rng.choice([0, 0, 2])):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            rows.append(copy)
    return [" ".join(r) for r in rows] + [None, "", "a b", "A  b", " ".join(words) * 300]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4000, "hot_blocks": 3}])
def test_jaccard(spark, tmp_path, options):
    texts = near_copies(random.Random(8))
    found = jaccard.similar_documents(frame(spark, texts, 3, 2), f"file://{tmp_path}/j", **options)
    expected = jaccard.brute_force([(3 + 2 * i, t) for i, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


@pytest.mark.parametrize("options", [{"group": 5}, {"group": 5, "block_bytes": 4000, "hot_blocks": 0}, {"group": 2, "block_bytes": 4000, "hot_blocks": 1}])
def test_jaccard_of_groups_over_several_tasks(spark, tmp_path, options):
    texts = near_copies(random.Random(12))
    found = jaccard.similar_documents(frame(spark, texts, 3, 2), f"file://{tmp_path}/j", **options)
    expected = jaccard.brute_force([(3 + 2 * i, t) for i, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert spark.read.parquet(f"file://{tmp_path}/j/wide").count() > 0


@pytest.mark.parametrize("hot_blocks", [None, 0, 1, 1000])
def test_no_set_is_posted_whole(spark, hot_blocks):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(204)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(20)] + [(99, " ".join(rng.sample(base, 200)))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    layout = blocks.lay_out(docs, 4000)
    posted = jaccard._postings(layout, layout.docs.select("doc_id", "block"), 5, 80, hot_blocks)
    counts = {r.doc_id: r["count"] for r in posted.where("kind = 'token'").groupBy("doc_id").count().collect()}
    most = jaccard.reserve_length(200) - jaccard.least_common(200) + 1
    assert len(counts) >= 20 and max(counts.values()) <= most < 60


def test_tiles_hold_every_open_pair_once_and_no_large_group(spark):
    rows = [(7, i, 5 if i < 600 else i) for i in range(700)] + [(8, i, 1) for i in range(300)] + [(9, i, i) for i in range(10)]
    labelled = spark.createDataFrame(rows, "token LONG, doc_id LONG, linked LONG")
    tiles = jaccard._tiles(labelled, jaccard.wide_tokens(labelled, 64), 64).collect()
    assert {r.token for r in tiles} == {7}
    held = {}
    for r in tiles:
        held.setdefault((r.low, r.high), []).append(r)
    assert max(map(len, held.values())) <= 4 * 64
    pairs = [tuple(sorted((x.doc_id, y.doc_id))) for (low, high), t in held.items() for k, x in enumerate(t) for y in t[:k] if low == high or x.side != y.side]
    assert len(pairs) == len(set(pairs))
    assert {p for p in pairs if p[1] >= 600} == {(i, j) for j in range(600, 700) for i in range(j)}
    assert not [p for p in pairs if p[1] < 600]


def test_jaccard_edges(spark, tmp_path):
    assert jaccard.similar_documents(empty(spark), f"file://{tmp_path}/e").count() == 0
    rows = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "A B C"), (None, "z"), (7, None)], "doc_id LONG, text STRING")
    got = sorted(map(repr, (tuple(r) for r in jaccard.similar_documents(rows, f"file://{tmp_path}/f").collect())))
    assert got == sorted(map(repr, [(2, 1, 2), (2, 1, 2), (None, 1, 2), (None, 1, None), (7, 0, 7)]))


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("block_bytes", [1000, blocks.BLOCK_BYTES])
def test_one_id_with_unlike_texts(spark, tmp_path, turned, block_bytes):
    rng = random.Random(3)
    words = lambda: [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
    a, b, c = words(), words(), words()
    near = lambda t: " ".join(t[:-1] + ["end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (9, " ".join(c)), (3, " ".join(c)), (3, "1 2"), (8, "1 2"), (3, None)]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id LONG, text STRING")
    found = jaccard.similar_documents(docs, f"file://{tmp_path}/s", block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (3, 3), (3, 3), (5, 5), (5, 5), (6, 5), (7, 5), (8, 3), (9, 3)]
    kept = jaccard.first_of_groups(docs, f"file://{tmp_path}/f")
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(kept, ["doc_id", "text_key"]).collect()
    assert sorted((r.doc_id, r.text or "") for r in texts) == sorted([(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(c)), (3, "1 2"), (3, "")])


def test_prefixes_meet():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        x = rng.sample(range(10**6), n)
        y = [t for t in x if rng.random() > 0.1] + rng.sample(range(10**6), rng.randint(0, 4))
        x, y = sorted(set(x)), sorted(set(y))
        if y and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
            reserve = [set(s[: jaccard.reserve_length(len(s))]) for s in (x, y)]
            common = len(reserve[0] & reserve[1])
            assert common >= max(jaccard.least_common(len(x)), jaccard.least_common(len(y)), 1) or common >= min(
                jaccard.least_common(len(x)), jaccard.least_common(len(y))
            )
            assert common >= jaccard.least_common(len(x)) and common >= jaccard.least_common(len(y))
            assert set(x[: jaccard.prefix_length(len(x))]) & set(y[: jaccard.prefix_length(len(y))])


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 62, 12).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(map(jaccard.bitmap, sets)), np.uint64).reshape(-1, jaccard.BITMAP_WORDS)
    found = {(int(i), int(j)) for a, b in jaccard.SignatureTree(sizes, bits, np.arange(100)).pairs() for i, j in zip(a, b)}
    real = {(i, j) for i in range(100) for j in range(i + 1, 100) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert real <= found and len(found) < 1200
    linked = np.zeros(100, np.int64)
    assert not list(jaccard.SignatureTree(sizes, bits, linked).pairs())


def test_pairs_are_reported_under_one_ngram():
    lists = np.stack([np.frombuffer(jaccard.first_of(np.array(t, np.uint64)), np.uint64) for t in ([9, 3, 5], [5, 4, 9], [1], range(20))])
    x, y = lists[[0, 0, 0, 1]], lists[[1, 2, 3, 3]]
    assert jaccard.met_elsewhere(5, x, y).tolist() == [False, False, True, True]
    assert jaccard.met_elsewhere(3, x, y).tolist() == [True, False, False, True]


def test_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(7)
    for n in (1, 3, 40, 700, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for loss in (0.0, 0.05, 0.1, 0.15, 0.5):
            other = np.unique(np.concatenate([base[rng.random(len(base)) >= loss], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
            if not len(other):
                continue
            common = len(np.intersect1d(base, other))
            similar = 100 * common >= 80 * (len(base) + len(other) - common)
            near = jaccard.may_be_similar(jaccard.sketch(base), len(base), jaccard.sketch(other), len(other))
            assert near or not similar
            assert n < 700 or loss < 0.5 or not near


def test_many_windows_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "WINDOWS_AT_ONCE", 64)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(40)) + "a common stretch of text" + "".join(rng.choice("ab") for _ in range(40))) for i in range(60)]
    cut = suffixes.remove_later_copies(spark.createDataFrame(rows, "doc_id LONG, text STRING"), length=28, gram=10)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()}
    assert got == suffixes.brute_force(rows, 28)


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "a LONG, b LONG"), f"file://{tmp_path}/c").collect()
    assert {r.vertex: r.component for r in got} == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert len(got) == 36
    assert components.connected_components(spark.createDataFrame([], "a LONG, b LONG"), f"file://{tmp_path}/d").count() == 0


# 9 decontamination


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"yy{rng.randrange(99)}")
    return words


def test_leaks_recall_and_exactness(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(30)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for i in range(150):
        filler = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 3:
            item = rng.choice(items[:30])[1].split()
            filler[len(filler) // 2 : len(filler) // 2] = edited(rng, item, rng.randint(0, int(0.25 * len(item))))
        docs.append((i, ", ".join(filler).title()))
    docs += [(500, None), (501, ""), (502, items[0][1]), (503, " ".join(rng.choices(vocabulary, k=60_000)) + " " + items[1][1])]
    table = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(table, benchmark).collect()}
    expected = decontaminate.brute_force(docs, [(i, t) for i, t in items if t])
    assert set(got) <= set(expected) and all(got[k] >= expected[k] for k in got)
    assert len(got) >= 0.95 * len(expected) and {k for k, d in expected.items() if d == 0} <= set(got)
    clean = decontaminate.without_leaks(table.withColumn("bits", F.lit(1)), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got} and "bits" in clean.columns


def test_leaks_of_short_items_and_scripts_without_spaces(spark):
    chinese = "今天天气很好我们一起去公园散步"
    items = [(1, "Paris"), (2, "two short words here"), (3, chinese), (4, "he said “stop” — then left the room")]
    docs = [
        (1, "We saw PARIS, then left."), (2, "a two-short words here!"), (3, "two short words there"), (4, "前言:" + chinese + "。后记"),
        (5, chinese[:6] + "真" + chinese[7:]), (6, 'he said "stop" - then left the room'), (7, "nothing"), (8, "parisian"), (9, "昨天下雨"),
    ]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (4, 3): 0, (5, 3): 1, (6, 4): 0} == decontaminate.brute_force(docs, items)


@pytest.mark.parametrize("size", [1, 5, 12, 30, 59])
def test_no_walk_gives_unlike_windows_one_key(size):
    rng = np.random.default_rng(1)
    index = decontaminate.ItemIndex([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, size))) for i in range(20)], 0.2, 0.98)
    own = index.sizes[size]
    keys = decontaminate.embed(rng.integers(1, 1 << 62, (2000, size)).astype(np.uint64), own.walks, own.places)
    assert len(own.walks) < decontaminate.MOST_WALKS
    assert all(np.unique(keys[:, w], return_counts=True)[1].max() < 200 for w in range(keys.shape[1]))


@pytest.mark.parametrize("item_bytes", [300, 4 << 20])
def test_benchmark_in_several_chunks(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 12, 30])))) for i in range(24)]
    texts = [(i, " ".join(rng.choices(words, k=20) + (items[i % 24][1].split() if i % 2 else []) + rng.choices(words, k=20))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    expected = decontaminate.brute_force(texts, items)
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == expected
    clean = decontaminate.without_leaks(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in expected}


def with_edits(words, e, rng):
    words = words.tolist()
    for _ in range(e):
        kind, at = int(rng.integers(3)), int(rng.integers(len(words)))
        if kind == 0:
            words[at] = int(rng.integers(1, 1 << 62))
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, int(rng.integers(1, 1 << 62)))
    return words


@pytest.mark.parametrize("size", [12, 25, 59, 200])
def test_recall_of_fresh_copies(size):
    rng = np.random.default_rng(11)
    index = decontaminate.ItemIndex([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, size))) for i in range(40)], 0.2, 0.98)
    own, met, tried = index.sizes[size], 0, 0
    for at, (_, words) in enumerate(index.items):
        for _ in range(10):
            copy = with_edits(words, index.allowed[at], rng)
            text = np.array([*rng.integers(1, 1 << 62, 30), *copy, *rng.integers(1, 1 << 62, 30)], np.uint64)
            tried += 1
            met += any(item == at for _, item in index.pairs(text, np.zeros(len(text), np.int64)))
    assert met / tried >= 0.96 and (not own.exact or met == tried)


def test_items_that_walks_miss_are_found_exactly(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 1)
    rng = np.random.default_rng(12)
    index = decontaminate.ItemIndex([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60))) for i in range(10)], 0.2, 0.98)
    assert index.sizes[60].exact
    for at, (_, words) in enumerate(index.items):
        text = np.array([*rng.integers(1, 1 << 62, 30), *with_edits(words, index.allowed[at], rng), *rng.integers(1, 1 << 62, 30)], np.uint64)
        assert at in {item for _, item in index.pairs(text, np.zeros(len(text), np.int64))}


def test_leaks_of_nothing(spark):
    docs, none = frame(spark, ["a b c d e f"]), spark.createDataFrame([], "item_id LONG, text STRING")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.without_leaks(docs, none).count() == 1
    benchmark = spark.createDataFrame([(1, "a B c, d e f"), (1, "a B c, d e f"), (None, "a b c d e f")], "item_id LONG, text STRING")
    assert decontaminate.find_leaks(empty(spark), benchmark).count() == 0
    assert sorted((r.doc_id, r.item_id or -1) for r in decontaminate.find_leaks(docs, benchmark).collect()) == [(0, -1), (0, 1)]


def test_edit_distance_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = (rng.integers(0, 4, n).astype(np.uint64) for n in rng.integers(1, 12, 2))
        table = np.zeros((len(item) + 1, len(text) + 1), int)
        table[:, 0] = np.arange(len(item) + 1)
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (item[i - 1] != text[j - 1]))
        distance, start, end = decontaminate.edits_within(item, text)
        assert distance == table[-1].min() and 0 <= start <= end <= len(text)


# 10 WARC


def archived(spark, rows, folder, **options):
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    return warc.read_warc(warc.write_warc(warc.with_revisits(pages, **options), folder), 700)


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(4).choice("abcdefgh é\n") for _ in range(50_000))
    rows = [(1, "http://a/ b", "<p>x"), (2, "u", "<p>x"), (3, None, None), (4, "v", ""), (5, "w", big), (6, "w", big), (7, "x", "WARC/1.1\r\n\r\n")]
    got = {r.page_id: r for r in archived(spark, rows, f"file://{tmp_path}/w").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("revisit", 6), 6: ("response", None), 7: ("response", None),
    }
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), warc.payload_digest(data))
        assert got[page_id].payload == (data if got[page_id].record_type == "response" else None)
    whole = archived(spark, rows, f"file://{tmp_path}/least", least_bytes=100)
    assert {r.page_id for r in whole.collect() if r.record_type == "revisit"} == {5}


def test_warc_headers_of_any_length(spark, tmp_path):
    rng = random.Random(5)
    urls = {1: "http://a/" + "x" * 70_000, 2: "http://b/" + "".join(rng.choices("abcdef0123456789", k=100_000)), 3: "http://c/" + "".join(rng.choices("abcdef0123456789", k=1_000_000)), 4: "d"}
    got = {r.page_id: r for r in archived(spark, [(i, u, f"page {i}") for i, u in urls.items()], f"file://{tmp_path}/w").collect()}
    assert {i: (r.target_uri, r.payload) for i, r in got.items()} == {i: (u, f"page {i}".encode()) for i, u in urls.items()}


def test_warc_splits_and_damage(tmp_path):
    import io

    rng = random.Random(6)
    parts, starts = [], []
    for i in range(60):
        starts.append(sum(map(len, parts)))
        parts.append(warc.record_bytes(i, "u", rng.randbytes(rng.randint(0, 900)).hex().encode(), None))
        if i % 5 == 0:  # bytes that look like the start of a member
            parts.append(warc.MAGIC + b"\x00junk" + warc.MAGIC)
    data = b"".join(parts)
    for step in (1, 97, 1000, len(data)):
        found = [o for s in range(0, len(data), step) for o, _, _ in warc.scan_range(io.BytesIO(data), len(data), s, min(len(data), s + step))]
        assert found == starts


def test_warc_of_nothing(spark, tmp_path):
    assert archived(spark, [], f"file://{tmp_path}/n").count() == 0
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "y")]
    assert sorted(map(repr, ((r.page_id, r.record_type) for r in archived(spark, rows, f"file://{tmp_path}/t").collect()))) == sorted(
        map(repr, [(1, "response"), (1, "response"), (None, "response")])
    )
    shutil.rmtree(tmp_path, ignore_errors=True)
