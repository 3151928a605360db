"""Removal of repeated word sequences by recompression.

A text's words are renamed in rounds. A round over runs gives ``a a a`` one name; a round over
pairs parts all names into left and right ones by a bit of the name, and gives each left name
that stands before a right one a common name with it. Names are fingerprints, so every task of
every round gives equal sequences the same name without a shuffle. Whether two neighbours are
joined depends on those two alone; each symbol carries the range of words that decided it, and a
window that covers the range holds the symbol wherever the window occurs.

Spark rounds then (1) find the high-level symbols that occur more than once, which rules out
every window that holds another one, and (2) verify the windows that are left by 96-bit
fingerprints of their words. Windows that hold no complete symbol are never ruled out by (1), so the
result does not depend on how the text was parsed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from topicflow.llm import blocks
from topicflow.llm.common import BASES, mix, powers, texts_as_bytes, window_hashes, word_bounds, word_hashes

WIDTH = 35
PAIR_ROUNDS, LONGEST = 6, 12
#: Bytes of text that are parsed at once.
AT_ONCE = 1 << 20
_FAR = np.int64(1) << np.int64(40)


@dataclass
class Symbols:
    """Names over the words of several texts, with the words ``[low, high)`` that decide each."""

    names: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _widened(s: Symbols, to_left: np.ndarray, to_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that also take in those of the left or right neighbour; a text's edge is out of reach of any window."""
    low, high = s.low.copy(), s.high.copy()
    left_low = np.concatenate([[0], s.low[:-1]])
    left_high = np.concatenate([[0], s.high[:-1]])
    right_low, right_high = np.append(s.low[1:], 0), np.append(s.high[1:], 0)
    at = to_left & ~s.first
    low[at], high[at] = np.minimum(low[at], left_low[at]), np.maximum(high[at], left_high[at])
    at = to_right & ~s.last
    low[at], high[at] = np.minimum(low[at], right_low[at]), np.maximum(high[at], right_high[at])
    low[to_left & s.first] = -_FAR
    high[to_right & s.last] = _FAR
    return low, high


def _name_runs(s: Symbols) -> Symbols:
    n = len(s.names)
    everywhere = np.ones(n, bool)
    low, high = _widened(s, everywhere, everywhere)
    start = np.ones(n, bool)
    start[1:] = (s.names[1:] != s.names[:-1]) | s.first[1:]
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, n))
    names = s.names[at]
    named = length > 1
    names[named] = mix(names[named] * BASES[2] + length[named].astype(np.uint64))
    ends = at + length - 1
    return Symbols(
        names, np.add.reduceat(s.sizes, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), s.first[at], s.last[ends]
    )


def _name_pairs(s: Symbols, turn: int, turns: np.ndarray) -> Symbols:
    n = len(s.names)
    left = (mix(s.names ^ turns[turn]) & np.uint64(1)).astype(bool)
    joined = np.zeros(n, bool)
    joined[:-1] = left[:-1] & ~left[1:] & ~s.last[:-1] & (s.sizes[:-1] + s.sizes[1:] <= LONGEST)
    second = np.concatenate([[False], joined[:-1]])
    open_ = ~joined & ~second & (s.sizes < LONGEST)
    low, high = _widened(s, open_ & ~left, open_ & left)
    names, sizes, last = s.names.copy(), s.sizes.copy(), s.last.copy()
    at = np.flatnonzero(joined)
    names[at] = mix(s.names[at] * BASES[2] + mix(s.names[at + 1] + BASES[3]))
    sizes[at] += s.sizes[at + 1]
    low[at], high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
    last[at] = s.last[at + 1]
    kept = ~second
    return Symbols(names[kept], sizes[kept], low[kept], high[kept], s.first[kept], last[kept])


def recompress(words: np.ndarray, text_of: np.ndarray, rounds: int = PAIR_ROUNDS) -> Symbols:
    """Symbols over word fingerprints of consecutive texts (``text_of`` tells which)."""
    n = len(words)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = text_of[1:] != text_of[:-1]
    at = np.arange(n, dtype=np.int64)
    s = Symbols(mix(words), np.ones(n, np.int64), at, at + 1, edge[:-1], edge[1:])
    if n:
        s, turns = _name_runs(s), powers(int(BASES[1]), rounds + 1)[1:]
        for turn in range(rounds):
            s = _name_pairs(s, turn, turns)
    return s


@dataclass
class Parsed:
    """Some texts of a block: their words and the symbols that decide which windows may repeat."""

    rows: range
    counts: np.ndarray
    words: np.ndarray
    valid: np.ndarray
    symbols: Symbols


def _parse(texts: list[bytes], width: int, rounds: int):
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= AT_ONCE):
            held += len(texts[end])
            end += 1
        data = np.frombuffer(b" ".join(texts[start:end]), np.uint8)
        begins, ends = word_bounds(data)
        sizes = np.array([len(t) + 1 for t in texts[start:end]])
        text_of = np.searchsorted(np.cumsum(sizes), begins, "right")
        words = word_hashes(data, begins, ends)
        counts = np.bincount(text_of, minlength=end - start)
        valid = np.zeros(len(words), bool)
        if len(words) >= width:
            valid[: len(words) - width + 1] = text_of[width - 1 :] == text_of[: len(words) - width + 1]
        s = recompress(words, text_of, rounds)
        usable = (s.high - s.low <= width) & (counts[text_of[np.minimum(np.maximum(s.low, 0), max(len(words) - 1, 0))]] >= width if len(words) else True)
        kept = Symbols(s.names[usable], s.sizes[usable], s.low[usable], s.high[usable], s.first[usable], s.last[usable])
        yield Parsed(range(start, end), counts, words, valid, kept)
        start = end


def _symbol_keys(parsed: list[Parsed]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All usable names of a block in their order, the sorted distinct ones, and which occur more than once."""
    names = np.concatenate([p.symbols.names for p in parsed] or [np.zeros(0, np.uint64)])
    keys, counts = np.unique(names, return_counts=True)
    return names, keys, counts > 1


def _candidates(parsed: list[Parsed], answers: pa.Table, n_parts: int, width: int):
    """Key, check and place of every window without a symbol that occurs only once."""
    names, keys, _ = _symbol_keys(parsed)
    (shared,) = blocks.answered(answers, 1, keys, n_parts)
    alone = ~shared[np.searchsorted(keys, names)] if len(names) else np.zeros(0, bool)
    at, found = 0, []
    for p in parsed:
        n = len(p.symbols.names)
        single = alone[at : at + n]
        at += n
        ruled_out = np.zeros(len(p.words) + 1, np.int32)
        np.add.at(ruled_out, np.maximum(p.symbols.high[single] - width, 0), 1)
        np.add.at(ruled_out, p.symbols.low[single] + 1, -1)
        starts = np.flatnonzero(p.valid & (np.cumsum(ruled_out)[:-1] == 0))
        hashes = window_hashes(p.words, width, BASES[0])[starts] if len(starts) else np.zeros(0, np.uint64)
        checks = (window_hashes(p.words, width, BASES[3])[starts] if len(starts) else hashes) >> np.uint64(32)
        found.append((starts, hashes, checks.astype(np.uint32)))
    return found


def _windows(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)])
    checks = np.concatenate([f[2] for f in found] or [np.zeros(0, np.uint32)])
    order, group, first = blocks.distinct(keys, checks)
    count = np.diff(np.append(first, len(keys)))
    return keys, order, group, keys[order][first], checks[order][first], count > 1


def remove_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = PAIR_ROUNDS, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``docs`` without the words that lie in a window of ``width`` words occurring anywhere else too.

    Adds ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed`` to the columns
    of ``docs``, which must not have these names. Every occurrence of a repeated window goes, the
    first too; windows are judged on the input. Null and empty texts have no words and stay as they
    are; repeated rows repeat each other and lose all windows; texts under ``width`` words lose
    nothing. Texts are read whole.
    """
    layout = blocks.lay_out(docs, block_bytes)
    n_parts = layout.n_parts

    def symbols(block: int, table: pa.Table, _) -> pa.Table:
        _, keys, several = _symbol_keys(list(_parse(texts_as_bytes(table["text"].combine_chunks()), width, rounds)))
        return blocks.key_table(blocks.key_rows(block, keys, None, several, n_parts))

    def windows(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blocks.key_table([])
        parsed = list(_parse(texts_as_bytes(table["text"].combine_chunks()), width, rounds))
        _, _, _, keys, checks, several = _windows(_candidates(parsed, answers, n_parts, width))
        return blocks.key_table(blocks.key_rows(block, keys, checks, several, n_parts))

    names = docs.columns
    added = [StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]

    def cut(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_as_bytes(table["text"].combine_chunks()) if table.num_rows else []
        parsed = list(_parse(texts, width, rounds))
        found = _candidates(parsed, answers, n_parts, width)
        _, order, group, keys, _, _ = _windows(found)
        (shared,) = blocks.answered(answers, 2, keys, n_parts)
        repeated = np.empty(len(order), bool)
        repeated[order] = shared[group]
        kept, n_words, n_removed, at = [], [], [], 0
        for p, (starts, _, _) in zip(parsed, found):
            own = starts[repeated[at : at + len(starts)]]
            at += len(starts)
            covered = np.zeros(len(p.words) + 1, np.int32)
            np.add.at(covered, own, 1)
            np.add.at(covered, own + width, -1)
            keep = np.cumsum(covered)[:-1] == 0
            ends = np.cumsum(p.counts)
            for row, n, end in zip(p.rows, p.counts, ends):
                mask = keep[end - n : end]
                left = int(mask.sum())
                words = texts[row].split()
                kept.append(b" ".join(words if left == n else compress(words, mask.tolist())))
                n_words.append(int(n))
                n_removed.append(int(n) - left)
        columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.Table.from_arrays([*(table[c] for c in names), *columns], [*names, *(f.name for f in added)])

    first = blocks.shared_keys(blocks.ask(layout, None, symbols, blocks.KEYS), 1)
    second = blocks.shared_keys(blocks.ask(layout, first, windows, blocks.KEYS), 2)
    return blocks.ask(layout, first.unionByName(second), cut, StructType([*docs.schema.fields, *added]))


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """The same by its definition, for small tests: words, words removed, digest of what is kept."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for words in split:
        gone = {j for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
