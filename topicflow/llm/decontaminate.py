"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distances.

Words are symbols. A random walk over a sequence (it stays or moves on by a random bit of the symbol and the
time) turns edit distance into Hamming distance: two sequences that differ by an edit soon
walk in step again. Sampled places of the embeddings are LSH keys; walks are repeated until a simulated item
with the most edits allowed is met with the wanted recall. Pairs that meet are checked exactly.

Embedding every window of a corpus would be wasteful, and need not be: of ``e + 1`` pieces of an
item at least one survives ``e`` edits whole, so only windows around an exact piece are embedded. This
loses no window that could pass the check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicflow.llm.common import BASES, bytes_total, mix, slices, window_hashes, word_hashes
from topicflow.session import shared_dir

#: Share of an item's words that may be edited; items too short for an edit are looked for exactly.
EDITS = 0.2
RECALL, SAMPLED, MOST_WALKS = 0.98, 2, 96
#: Copies that recall is measured on, and by how much it must lie above what is promised, as it is measured on a sample.
COPIES, MARGIN = 500, 0.008
#: Bytes of items that one pass over the documents looks for; larger benchmarks take several passes.
ITEM_BYTES = 4 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Characters of scripts without spaces between words: Thai, Lao, Myanmar, Khmer, Japanese and Chinese.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Spaces, quotes, dashes and other punctuation outside ASCII.
_MARKS = re.compile("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u301f\u30fb\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
MATCHES = "doc_id LONG, item_id LONG, start_word LONG, end_word LONG, distance LONG, item_words LONG"


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of consecutive texts and the text of each; words are runs of letters and digits."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    return word_hashes(data, starts, ends), text_of


def folded(text: str | None) -> bytes:
    """Lower case; outside ASCII, punctuation parts words, and a character of a script without spaces is a word."""
    low = (text or "").lower()
    if not low.isascii():
        low = _SPACELESS.sub(r" \g<0> ", _MARKS.sub(" ", low))
    return low.encode("utf-8", "surrogatepass")


def last_time(size: int) -> int:
    """Time before which no more than about 1 % of the walks over ``size`` words have come to the end, where all look alike."""
    return max(size, int(((np.sqrt(2.33**2 + 8 * size) - 2.33) / 2) ** 2))


def embed(windows: np.ndarray, walks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """LSH keys (windows × walks) of sequences of one length: sampled places of each walk's embedding.

    ``walks`` holds a seed per walk, ``places`` the sampled times of each, sorted.
    """
    count, length = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
    rows = np.arange(count)
    keys = np.empty((count, len(walks)), np.uint64)
    for w, seed in enumerate(walks):
        at = np.zeros(count, np.int64)
        key = np.full(count, np.uint64(w))
        wanted = set(places[w].tolist())
        for time in range(int(places[w][-1]) + 1):
            symbol = padded[rows, at]
            if time in wanted:
                key = mix(key * BASES[2] + symbol)
            step = mix(symbol ^ (seed + np.uint64(time * 0x9E3779B9)))
            at = np.minimum(at + (step & np.uint64(1)).astype(np.int64), length)
        keys[:, w] = key
    return keys


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(least edit distance, start, end) of the item against any part of the text; of equal ones the first end."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        swap = cost[:-1] + (text != word)
        new, origin = cost + 1, start.copy()
        better = swap < new[1:]
        new[1:] = np.where(better, swap, new[1:])
        origin[1:] = np.where(better, start[:-1], origin[1:])
        # insertions run on from the least of new[j] - j before
        lifted = new - at
        best = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == best, at, 0))
        cost, start = best + at, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


@dataclass
class _Size:
    """Items of one number of words."""

    items: list[int]
    keys: np.ndarray
    owners: np.ndarray
    walks: np.ndarray
    places: np.ndarray
    #: whether so many walks meet too few copies, so that every window around a piece is verified instead
    exact: bool


class ItemIndex:
    """Items by exact pieces and by LSH keys. Items of a length for which walks do not reach the recall have pieces only."""

    def __init__(self, items: list[tuple[int, str]], edits: float, recall: float) -> None:
        found = [(i, words_in([folded(t)])[0]) for i, t in items]
        self.items = [(i, w) for i, w in found if len(w)]
        self.allowed = [int(edits * len(w)) for _, w in self.items]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for at, ((_, words), e) in enumerate(zip(self.items, self.allowed)):
            bounds = [len(words) * i // (e + 1) for i in range(e + 2)]
            for s, t in zip(bounds, bounds[1:]):
                pieces.setdefault(t - s, []).append((int(window_hashes(words[s:t], t - s, BASES[0])[0]), at, s))
        self.pieces = {}
        for size, rows in pieces.items():
            rows.sort()
            self.pieces[size] = tuple(np.array(c, k) for c, k in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        self.sizes: dict[int, _Size] = {}
        for size in sorted({len(w) for _, w in self.items}):
            own = [at for at, (_, w) in enumerate(self.items) if len(w) == size]
            rng = np.random.default_rng(size)
            walks = rng.integers(0, 1 << 63, MOST_WALKS, dtype=np.uint64)
            places = np.sort(rng.integers(0, last_time(size), (MOST_WALKS, SAMPLED)), axis=1)
            n = walks_needed(np.stack([self.items[at][1] for at in own[:20]]), self.allowed[own[0]], walks, places, recall, rng)
            exact, n = n is None, n or 0
            keys = embed(np.stack([self.items[at][1] for at in own]), walks[:n], places[:n])
            order = np.argsort(keys.ravel(), kind="stable")
            self.sizes[size] = _Size(own, keys.ravel()[order], np.repeat(own, n)[order], walks[:n], places[:n], exact)

    def windows(self, words: np.ndarray, text_of: np.ndarray) -> tuple[dict[int, np.ndarray], set[tuple[int, int]]]:
        """Starts of the windows around exact pieces, by their number of words; and the places of items that are not looked for by walks."""
        out: dict[int, list[np.ndarray]] = {}
        found: set[tuple[int, int]] = set()
        for size, (hashes, owners, offsets) in self.pieces.items():
            have = window_hashes(words, size, BASES[0])
            low = np.searchsorted(hashes, have, "left")
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == have))
            hit = hit[text_of[hit] == text_of[hit + size - 1]]
            for at, first in zip(hit.tolist(), low[hit].tolist()):
                while first < len(hashes) and hashes[first] == have[at]:
                    owner = int(owners[first])
                    e = self.allowed[owner]
                    length = len(self.items[owner][1])
                    start = at - int(offsets[first])
                    if self.sizes[length].exact:
                        found.add((start, owner))
                    else:
                        out.setdefault(length, []).append(np.arange(start - e, start + e + 1))
                    first += 1
        return {length: np.unique(np.concatenate(starts)) for length, starts in out.items()}, found

    def pairs(self, words: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window start, item) that meet under some walk; windows reach beyond a text's edge as empty words."""
        by_length, found = self.windows(words, text_of)
        yield from sorted(found)
        for length, starts in by_length.items():
            size = self.sizes[length]
            for s in range(0, len(starts), 4096):
                own = starts[s : s + 4096]
                places = own[:, None] + np.arange(length)
                inside = (places >= 0) & (places < len(words))
                safe = np.clip(places, 0, len(words) - 1)
                middle = text_of[np.clip(own + length // 2, 0, len(words) - 1)]
                inside &= text_of[safe] == middle[:, None]
                keys = embed(np.where(inside, words[safe], np.uint64(0)), size.walks, size.places)
                low = np.searchsorted(size.keys, keys)
                met = (low < len(size.keys)) & (size.keys[np.minimum(low, len(size.keys) - 1)] == keys)
                for row, walk in zip(*np.nonzero(met)):
                    at = int(low[row, walk])
                    while at < len(size.keys) and size.keys[at] == keys[row, walk]:
                        yield int(own[row]), int(size.owners[at])
                        at += 1


def walks_needed(items: np.ndarray, e: int, walks: np.ndarray, places: np.ndarray, recall: float, rng) -> int | None:
    """Walks after which simulated copies with ``e`` edits are met with the wanted recall; None if there are too few."""
    copies = []
    wanted = min(1.0, recall + MARGIN)
    for words in np.repeat(items, max(1, COPIES // len(items)), axis=0):
        edited = words.tolist()
        for _ in range(e):
            kind, at = rng.integers(3), int(rng.integers(len(edited))) if edited else 0
            if kind == 0 and edited:
                edited[at] = int(rng.integers(1, 1 << 62))
            elif kind == 1 and edited:
                del edited[at]
            else:
                edited.insert(at, int(rng.integers(1, 1 << 62)))
        size = items.shape[1]
        copies.append((edited + [0] * size)[:size])
    edited_items = np.array(copies, np.uint64)
    ours = np.repeat(items, max(1, COPIES // len(items)), axis=0)
    both = np.concatenate([edited_items, ours])
    met = np.zeros(len(ours), bool)
    for n in range(len(walks)):
        keys = embed(both, walks[n : n + 1], places[n : n + 1])[:, 0]
        met |= keys[: len(ours)] == keys[len(ours) :]
        if met.mean() >= wanted:
            return n + 1
    return None


def _leaks(part: pa.RecordBatch, index: ItemIndex) -> list[tuple]:
    """(row, item, start, end, distance) of the items that a part's texts hold."""
    words, text_of = words_in([folded(t) for t in part.column("text").to_pylist()])
    if not len(words) or not index.items:
        return []
    bounds = np.searchsorted(text_of, np.arange(part.num_rows + 1))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    checked: set[tuple[int, int, int]] = set()
    for start, at in index.pairs(words, text_of):
        item, e = index.items[at][1], index.allowed[at]
        text = int(text_of[min(max(start + len(item) // 2, 0), len(words) - 1)])
        # windows that begin within e words of each other are checked together, over a stretch that holds them all
        group = start // (e + 1)
        if (text, at, group) in checked:
            continue
        checked.add((text, at, group))
        low, high = max(bounds[text], start - 2 * e), min(bounds[text + 1], start + len(item) + 2 * e)
        if low < high:
            distance, s, t = edits_within(item, words[low:high])
            if distance <= e:
                own = (distance, int(low + s - bounds[text]), int(low + t - bounds[text]))
                best[text, at] = min(best.get((text, at), own), own)
    return [(row, at, s, t, d) for (row, at), (d, s, t) in sorted(best.items())]


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in chunks of bounded size, fetched one after the other; each means one pass over the documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chunks = max(1, -(-bytes_total(items, "text") // ITEM_BYTES))
    chunk_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    for c in range(chunks):
        rows = {(r["item_id"], r["text"]) for r in items.where(chunk_of == c).collect()}
        yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _passes(docs: DataFrame, benchmark: DataFrame, edits: float, recall: float, name: str, one_pass) -> Iterator[DataFrame]:
    """What ``one_pass(documents, index)`` gives for each chunk of items.

    The last stays lazy; all before are written to the shared folder before the next index is built, so the driver holds one index at a time.
    """
    spark, waiting, folder, turn = docs.sparkSession, None, None, 0
    for chunk in _chunks(benchmark):
        if waiting is not None:
            folder = folder or shared_dir(spark, name)
            waiting.write.parquet(f"{folder}/{turn}")
            docs = yield spark.read.schema(waiting.schema).parquet(f"{folder}/{turn}")
            turn += 1
        waiting = one_pass(docs, ItemIndex(chunk, edits, recall))
    yield waiting


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """One row per document and item that it holds with at most ``edits`` of the item's words edited.

    ``distance`` is the least word edit distance of the item to any part of the document near a
    meeting, ``start_word`` and ``end_word`` that part. Case and punctuation do not count. Null and
    wordless texts match nothing, repeated rows match each
    for itself, equal rows of the benchmark count once. Documents are read once per ``ITEM_BYTES`` of items (an
    index that is sent to the tasks is bounded so) and nothing is shuffled. Texts are read whole.
    """
    names = [x.split()[0] for x in MATCHES.split(", ")]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pass_over(_: DataFrame, index: ItemIndex) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for part in slices(batch, "text", 1 << 20):
                    ids = part.column("doc_id").to_pylist()
                    rows += [(ids[x], index.items[at][0], s, t, d, len(index.items[at][1])) for x, at, s, t, d in _leaks(part, index)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

        return slim.mapInArrow(search, MATCHES)

    out = None
    for found in _passes(slim, benchmark, edits, recall, "leaks", pass_over):
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item; see ``find_leaks``."""
    schema = docs.schema

    def pass_over(rest: DataFrame, index: ItemIndex) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    hit = {row for row, *_ in _leaks(part, index)}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        return rest.mapInArrow(clean, schema)

    passes = _passes(docs, benchmark, edits, recall, "clean", pass_over)
    rest = next(passes)
    while True:
        try:
            rest = passes.send(rest)  # the next pass reads what this one left
        except StopIteration:
            return rest


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str]], edits: float = EDITS) -> dict[tuple[int, int], int]:
    """Least distances of all items to all documents by the full table, for small tests."""
    out = {}
    for i, text in docs:
        words = words_in([folded(text)])[0]
        for j, item in items:
            wanted = words_in([folded(item)])[0]
            if len(wanted) and len(words):
                distance = edits_within(wanted, words)[0]
                if distance <= int(edits * len(wanted)):
                    out[i, j] = distance
    return out
