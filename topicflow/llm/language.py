"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language in order. A text is put in the
language whose profile is nearest to the ranking of its own n-grams: the sum, over the text's
most frequent n-grams, of how far each stands out of place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicflow.llm.common import slices

#: N-grams of one to three characters; 300 of them make a ranking.
ORDERS, RANKS = (1, 2, 3), 300
#: Rows of each language that profiles are fitted on, about: those with the smallest hashes.
FIT_ROWS = 4000
#: Characters counted at once; longer texts are counted in pieces and the counts added.
PIECE = 1 << 20
UNKNOWN = "und"
_GRAM_BITS, _CHAR_BITS = 30, 10


def _classes(text: str) -> np.ndarray:
    """Characters as small numbers: letters folded to ten bits, everything else 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint16)
    ascii_letter = (codes >= 97) & (codes <= 122)
    other = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7)
    if other.any():
        rare = np.unique(codes[other])
        letters = rare[np.fromiter((chr(c).isalpha() for c in rare), bool, len(rare))]
        other = other & np.isin(codes, letters)
    folded = np.where(codes < 1023, codes + 1, 1 + (codes.astype(np.uint64) * 2654435761 >> 7) % 1023)
    return np.where(ascii_letter | other, folded, 0).astype(np.uint16)


def _grams(classes: np.ndarray, starts: int) -> np.ndarray:
    """Packed n-grams that begin at the first ``starts`` characters, with a letter in front of the last place."""
    found = []
    for n in ORDERS:
        count = min(starts, len(classes) - n + 1)
        if count > 0:
            packed = np.zeros(count, np.uint64)
            for i in range(n):
                packed = (packed << np.uint64(_CHAR_BITS)) | classes[i : count + i]
            found.append(packed[packed != 0] if n == 1 else packed[(packed >> np.uint64(_CHAR_BITS)) != 0])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often each occurs; gaps between words count as one character."""
    text = f" {text or ''} "
    classes = np.concatenate([_classes(text[s : s + PIECE]) for s in range(0, len(text), PIECE)])
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
    classes = classes[keep]
    counted = [
        np.unique(_grams(classes[s : s + PIECE + max(ORDERS) - 1].astype(np.uint64), PIECE), return_counts=True)
        for s in range(0, len(classes), PIECE)
    ]
    if len(counted) == 1:
        return counted[0]
    merged, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return merged, np.bincount(at, np.concatenate([c for _, c in counted])).astype(np.int64)


def ranking(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the smaller code is first."""
    if len(keys) > 4 * RANKS:
        cut = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        keys, counts = keys[counts >= cut], counts[counts >= cut]
    return keys[np.lexsort((keys, -counts))][:RANKS]


def fit_profiles(docs: DataFrame, rows_per_language: int = FIT_ROWS) -> dict[str, list[int]]:
    """Ranked n-grams of every language in ``docs`` (text, lang), most frequent first.

    The fit reads about ``rows_per_language`` texts of each language, chosen by a hash of the
    text, and all of a language that has fewer. Rows without a language or a text are skipped; no
    rows give no profiles. What reaches the driver is 300 n-grams per language.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_language / n))))
    uniform = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(uniform < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(count_grams(text))
            for lang, found in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    totals = chosen.mapInArrow(count, "lang STRING, gram LONG, n LONG").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # n-grams of a language are bounded by the alphabet, and few are frequent; the array keeps the first ones only
    best = totals.groupBy("lang").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))), 1, RANKS)["gram"].alias("grams")
    )
    return {r["lang"]: list(r["grams"]) for r in best.collect()}


class Profiles:
    """Rank of every profiled n-gram in each language, for distances of many texts."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for grams in profiles.values() for g in grams], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(profiles[lang], np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an n-gram that a profile lacks counts RANKS."""
        at = np.minimum(np.searchsorted(self.grams, ranked), len(self.grams) - 1)
        at = np.where(self.grams[at] == ranked, at, len(self.grams))
        theirs = self.ranks[:, at]
        apart = np.abs(theirs - np.arange(len(ranked), dtype=np.int32))
        return np.where(theirs < 0, RANKS, apart).sum(axis=1)


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) of every row, beside the columns named in ``passed``.

    Only the text decides. A null text, one without a letter, and any text when there is no
    profile get ``und`` and 0. Of equally near languages the first by name is taken. The score is
    one less the distance as a share of the largest possible. Repeated rows each give a row.
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed), "lang_pred STRING", "score DOUBLE"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles) if profiles else None
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                langs, scores = [], []
                for text in part.column("text").to_pylist():
                    ranked = ranking(*count_grams(text)) if known and text else ()
                    if len(ranked):
                        distances = known.distances(ranked)
                        best = int(np.argmin(distances))
                        langs.append(known.langs[best])
                        scores.append(1.0 - float(distances[best]) / (RANKS * len(ranked)))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in passed), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*passed, "lang_pred", "score"],
                )

    return docs.select(*passed, "text").mapInArrow(predict, schema)
