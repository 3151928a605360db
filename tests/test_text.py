import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from topicflow.functions import text as T
from topicflow.functions.words import STOP_WORDS


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i INT, s STRING")
    return [r["v"] for r in df.select("i", make(F.col("s")).alias("v")).orderBy("i").collect()]


CLEANED = {
    "a\nb\tc  d": "abc d",
    "\ufb01ne": "fine",
    "e\u0301x": "x",
    "a\u00a0b": "a b",
    "caf\u00e9 \u2014 na\u00efve": "caf nave",
    "\uff21\uff0c\uff22": "A,B",
    "\u00bd x\u00b2": "12 x2",
    "\u4e2d\u6587 ok\u200b\x7f": "ok",
    "\u037e": ";",
    "": "",
    None: "",
}


def test_clean_text(spark):
    assert values(spark, list(CLEANED), T.clean_text) == list(CLEANED.values())


def test_clean_text_restated(spark):
    """Against the definition, character by character, on mixed texts."""

    def restated(s):
        s = unicodedata.normalize("NFKC", s)
        s = "".join(c for c in s if unicodedata.category(c)[0] != "C")
        return re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]+", "", s)).strip()

    points = [*range(0x20, 0x250), *range(0x300, 0x320), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), 0x1100, 0x1161]
    inputs = [f"a{chr(p)}b {chr(p)}{chr(q)} c" for p, q in zip(points, reversed(points))]
    assert values(spark, inputs, T.clean_text) == [restated(s) for s in inputs]


def test_texts_are_normalised_a_few_at_a_time(spark):
    """Not in Arrow batches, of which a worker holds thousands of whole texts."""
    plan = spark.createDataFrame([("\ufb01ne",)], "s STRING").select(T.clean_text(F.col("s")))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_neutral_characters_cannot_matter():
    neutral = re.compile(f"[{T.NFKC_NEUTRAL}]")
    for point in range(0x80, 0x10000):
        c = chr(point)
        if not neutral.match(c):
            continue
        assert not any(ord(x) < 0x80 for x in unicodedata.normalize("NFKC", c)), hex(point)
        for base in "aAeEoOuUnNcCsS <>=":
            assert unicodedata.normalize("NFKC", base + c)[0] == base, hex(point)


@pytest.mark.parametrize(
    ("body", "needle", "count"),
    [("aaaaa", "aa", 2), ("c++ c++", "c++", 2), ("main", "ai", 1), ("", "x", 0), ("x", "zz", 0), ("éé", "é", 2)],
)
def test_mention_count(spark, body, needle, count):
    assert values(spark, [body], lambda s: T.mention_count(s, F.lit(needle))) == [count]
    assert body.count(needle) == count


def test_mentions_of_nothing(spark):
    assert values(spark, ["abc"], lambda s: T.mention_count(s, F.lit(""))) == [None]


def test_tokens(spark):
    texts = ["the graph of x deep-nets a_b 42", "été naïve", ""]
    got = values(spark, texts, lambda s: T.tokens(s))
    expected = [[w for w in re.findall(r"\b\w\w+\b", t) if w not in STOP_WORDS] for t in texts]
    assert got == expected


def test_neighbours(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (["a", None, "b", "c"],)], "w ARRAY<STRING>")
    got = [r["p"] for r in df.select(T.neighbours(F.col("w")).alias("p")).collect()]
    assert got == [["a b", "b c"], [], [], ["b c"]]


def test_strip_reasoning(spark):
    cases = {
        "<think>a</think>b</think> c": "c",
        "<think>a": "a",
        "b</think>": "b",
        " plain \n": "plain",
        "<think>x</think>\n\nanswer": "answer",
    }
    assert values(spark, list(cases), T.strip_reasoning) == list(cases.values())


def test_topic_lines(spark):
    assert values(spark, ["- graphs\n\n* text - mining \nthird\nfourth"], lambda s: T.topic_lines(s, 3)) == [
        ["graphs", "text - mining", "third"]
    ]
