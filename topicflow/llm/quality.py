"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per
failed rule; policies are bit masks with a version, applied later without the texts, and
ablations (what each rule rejects alone) are bitwise aggregates over the same ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from topicflow.llm.common import mix, texts_as_bytes, window_hashes

SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
UPPER = [bytes([b]) for b in range(65, 91)]
LOWER = [bytes([b]) for b in range(97, 123)]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Rule name and when a document fails it, in the order of the bits.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
)
BASE_RULES = ("too_few_words", "repeated_words")
#: Policies by version: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols"),
    # repeated lines are measured only: on labelled documents that rule rejects more good ones than bad
    "v2": (*BASE_RULES, "symbols", "word_length", "upper_case"),
    "strict": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    decoded = text.decode("utf-8", "replace")
    repeated = 0
    if n > REPEAT_WIDTH:
        codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        keys = window_hashes(mix(codes), REPEAT_WIDTH, np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        if len(same):
            covered = np.zeros(n + 1, np.int32)
            starts = np.union1d(order[same], order[same + 1])
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + REPEAT_WIDTH, -1)
            repeated = int((np.cumsum(covered)[:n] > 0).sum())
    lines = [line for line in text.split(b"\n") if line.strip(b"\t\x0b\x0c\r ")]
    spaces = sum(text.count(bytes([b])) for b in b"\t\n\x0b\x0c\r ")
    upper = sum(map(text.count, UPPER))
    letters = upper + sum(map(text.count, LOWER))
    symbols = sum(map(decoded.count, SYMBOLS))
    return n, len(decoded) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters


def _measured(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of the measurements, under a name that is free."""
    name = "measured"
    while name in docs.columns:
        name += "_"
    kinds = pa.struct([(m, pa.int64()) for m in MEASURES])

    def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(MEASURES, measure(text))) for text in texts_as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kinds)], [*batch.schema.names, name])

    struct = StructType([StructField(m, LongType()) for m in MEASURES])
    schema = StructType([*docs.schema.fields, StructField(name, struct)])
    return docs.mapInArrow(measure_batches, schema), name


def _bits(measured: str) -> Column:
    """One bit per rule that the measurements fail."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits + F.when(F.expr(re.sub(r"\b([nw]\w*_\w+)", rf"{measured}.\1", rule)), F.lit(1 << i).cast("long")).otherwise(0)
    return bits


def quality_ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` of every document; the only step that reads texts.

    Null and empty texts measure 0 everywhere and so fail ``too_few_words``. Repeated rows and
    repeated or null ids each give a row of their own; further columns of ``docs`` are not read.
    Counts are of whole texts, whatever their length.
    """
    frame, name = _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return frame.select("doc_id", f"{name}.*", _bits(name).alias("fail_bits"))


def passes(policy: str = CURRENT, bits: str | Column = "fail_bits") -> Column:
    """True where none of the policy's rules failed."""
    column = F.col(bits) if isinstance(bits, str) else bits
    return column.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it keeps out.

    One aggregate with map-side sums over the ledger; an empty ledger counts 0 everywhere.
    """
    mask = F.lit(mask_of(POLICIES[policy])).cast("long")
    failed = F.col("fail_bits").bitwiseAND(mask)
    counts = []
    for i, (name, _) in enumerate(RULES):
        if name in POLICIES[policy]:
            bit = F.lit(1 << i).cast("long")
            alone = F.count_if(failed == bit).alias("rejected_by_it_alone")
            counts.append(F.struct(F.lit(name).alias("rule"), F.count_if(failed.bitwiseAND(bit) != 0).alias("failed"), alone))
    one = ledger.agg(F.array(*counts).alias("rules"), F.count_if(failed == 0).alias("kept"))
    return one.select("kept", F.inline("rules"))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Documents that pass, with all their columns, whatever those are called.

    The measurements are taken beside the text in the same pass, so nothing is shuffled.
    """
    frame, name = _measured(docs)
    return frame.where(passes(policy, _bits(name))).drop(name)
