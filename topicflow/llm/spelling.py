"""Spelling variants of words, found with blocked Gram matrices of letter counts.

One edit changes a word's letter counts by a squared distance of one (a letter more or less) or two (a letter for another). Letters
are dealt to a few groups, and words with equally many letters of each group are a block; that splits each length into many
blocks, and an edit leads from a block only to itself, to one with a letter of one group for one of another, or to one
a letter shorter in one group. A block's words are sent to those blocks together; there the squared distances between the block's words and
all that came are a matrix product away, pairs at most two apart are kept, and their edit is verified on the letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_LETTERS, LEAST_COUNT = 5, 3
TYPO_EVERY = 97
#: In Latin-1, where a code point is a byte; A-Z are lower-cased before.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_END = re.compile(rb"[^a-z\xc0-\xff]")
_PIECE = 1 << 20
#: Distinct words, and their bytes, that a task holds before it passes them on.
_HELD, _HELD_BYTES = 1 << 18, 32 << 20
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))
#: Words a block has on average, about; words of a block that travel together.
BLOCK_WORDS, TILE_WORDS = 16, 2048


# words


def runs_of(text: str) -> Iterator[Counter]:
    """Maximal runs of letters and how often each occurs, A-Z in lower case, piece by piece of a long text."""
    data = text.encode("latin-1", "replace").lower()  # other code points become "?", which is no letter
    start = 0
    while start < len(data):
        end = start + _PIECE
        cut = _END.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield Counter(_RUN.findall(data, start, end))
        start = end


def misspelt(doc_id: int | None, run: bytes, prefix: int, every: int = TYPO_EVERY) -> bytes:
    """The run, without one letter where the checksum of ``<doc_id>:<run>`` says so; ``prefix`` is that of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``; counted in the tasks first, so a frequent word costs a row for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in runs_of(text.as_py() or ""):
                    for run, k in runs.items():
                        if len(run) < least_letters:
                            continue
                        word = misspelt(doc_id, run, prefix)
                        if len(word) >= least_letters:
                            if word not in held:
                                size += len(word)
                            held[word] += k
                    if len(held) > _HELD or size > _HELD_BYTES:
                        yield passed_on()
                        held.clear()
                        size = 0
        if held:
            yield passed_on()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word STRING, n LONG")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# blocks of words


class Words(NamedTuple):
    """Words in Latin-1, one behind the other."""

    letters: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        return cls(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)


def letter_counts(words: Words) -> np.ndarray:
    """How often each letter occurs in each word."""
    n = len(words.sizes)
    at = np.repeat(np.arange(n) * len(LETTERS), words.sizes) + _PLACE[words.letters]
    return np.bincount(at, minlength=n * len(LETTERS)).reshape(n, len(LETTERS))


def letter_groups(weights: np.ndarray, n_words: int, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """The group of each letter: groups of about equal weight, more of them the more words there are.

    Each group doubles the number of blocks and a bit more.
    """
    n = int(np.clip(2 + np.ceil(np.log2(max(1.0, n_words / block_words)) / 1.4), 3, 16))
    load, group = np.zeros(n), np.zeros(len(weights), np.int64)
    for letter in np.argsort(-weights, kind="stable"):
        group[letter] = int(np.argmin(load))
        load[group[letter]] += weights[letter] + 1e-9
    return group


def block_of(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").tobytes()


def neighbours(block: bytes) -> Iterator[bytes]:
    """The blocks that receive this one's words: of two blocks of one length the smaller in the order of its counts, of two lengths the shorter.

    So two words of unlike blocks meet once.
    """
    counts = np.frombuffer(block, "<u4").astype(np.int64)
    for i in np.flatnonzero(counts).tolist():
        counts[i] -= 1
        yield block_of(counts)
        for j in range(i + 1, len(counts)):
            counts[j] += 1
            yield block_of(counts)
            counts[j] -= 1
        counts[i] += 1


def copies(n_groups: int) -> int:
    """Blocks that a word is sent to, at most."""
    return 1 + n_groups + n_groups * (n_groups - 1) // 2


def with_blocks(words: DataFrame, group: np.ndarray) -> DataFrame:
    """``words`` (word, n) with their ``block``."""
    into = np.eye(int(group.max()) + 1, dtype=np.int64)[group]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                counts = letter_counts(Words.of([w.encode("latin-1") for w in part.column("word").to_pylist()])) @ into
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([block_of(c) for c in counts], pa.binary())], ["word", "n", "block"])

    return words.mapInArrow(place, "word STRING, n LONG, block BINARY")


MESSAGES = "block BINARY, home BOOLEAN, own BOOLEAN, tile INT, sizes BINARY, letters BINARY, n BINARY"


def _messages(placed: DataFrame, n_parts: int) -> DataFrame:
    """All words of a tile as one row for each block they go to; ``placed`` has word, n, block and tile.

    ``home`` is the tile where it lies, ``own`` its copy for the other tiles of its block.
    """

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("tile", "ascending")])
        blocks, tiles, n = table["block"].to_pylist(), table["tile"].to_pylist(), table["n"].to_numpy()
        words = [w.encode("latin-1") for w in table["word"].to_pylist()]
        rows: list[tuple] = []
        start = 0
        while start < len(words):
            end = start + 1
            while end < len(words) and blocks[end] == blocks[start] and tiles[end] == tiles[start]:
                end += 1
            flat = Words.of(words[start:end])
            content = (flat.sizes.astype("<u4").tobytes(), flat.letters.tobytes(), n[start:end].astype("<i8").tobytes())
            rows.append((blocks[start], True, False, tiles[start], *content))
            if tiles[start]:
                rows.append((blocks[start], False, True, tiles[start], *content))
            rows += [(block, False, False, tiles[start], *content) for block in neighbours(blocks[start])]
            start = end
        kinds = [pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = [field.split()[0] for field in MESSAGES.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("block", "tile"), F.lit(n_parts)))
    return dealt.select("part", "word", "n", "block", "tile").groupBy("part").applyInArrow(pack, MESSAGES)


def one_edit(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one letter inserted, deleted or replaced; lengths differ by one at most."""
    out = np.zeros(len(i), bool)
    a_size, b_size = x.sizes[i], y.sizes[j]
    a_start, b_start = (x.ends - x.sizes)[i], (y.ends - y.sizes)[j]
    kinds = np.stack([a_size, b_size], axis=1)
    for size, other in np.unique(kinds, axis=0).tolist():
        if abs(size - other) > 1:
            continue
        mine = np.flatnonzero((a_size == size) & (b_size == other))
        step = max(1, (4 << 20) // max(size, other))
        for s in range(0, len(mine), step):
            at = mine[s : s + step]
            a = x.letters[a_start[at][:, None] + np.arange(size)]
            b = y.letters[b_start[at][:, None] + np.arange(other)]
            if size == other:
                out[at] = (a != b).sum(axis=1) == 1
                continue
            short, long = (a, b) if size < other else (b, a)
            front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
            back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[at] = front + back >= min(size, other)
    return out


def near_pairs(x: Words, y: Words, same: bool = False, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs one edit apart; with ``same``, ``y`` is ``x`` and each pair comes once.

    Squared distances come from the Gram matrix of a stretch of ``x`` and one of ``y``, so memory is bounded by the two.
    """
    longest = max(x.sizes.max(), y.sizes.max())
    kind = np.float32 if longest < 2000 else np.float64  # products of counts stay exact
    for t in range(0, len(y.sizes), 16 * step):
        last = min(t + 16 * step, len(y.sizes))
        letters = slice(int(y.sizes[:t].sum()), int(y.sizes[:last].sum()))
        b = letter_counts(Words(y.letters[letters], y.sizes[t:last])).astype(kind)
        b_norm = np.einsum("ij,ij->i", b, b)
        for s in range(0, min(len(x.sizes), last) if same else len(x.sizes), step):
            end = min(s + step, len(x.sizes))
            letters = slice(int(x.sizes[:s].sum()), int(x.sizes[:end].sum()))
            a = letter_counts(Words(x.letters[letters], x.sizes[s:end])).astype(kind)
            apart = np.einsum("ij,ij->i", a, a)[:, None] + b_norm[None, :] - 2 * (a @ b.T)
            i, j = np.nonzero((apart > 0) & (apart <= 2))
            i, j = i + s, j + t
            if same:
                once = i < j
                i, j = i[once], j[once]
            if len(i):
                ok = one_edit(x, i, y, j)
                yield i[ok], j[ok]


NEAR = "word STRING, other STRING, other_n LONG"


def _unpacked(table: pa.Table, rows: list[int]) -> tuple[Words, np.ndarray, bytes]:
    """Words of some messages, their numbers, and all letters once more."""
    parts = [[table[c][r].as_py() for r in rows] for c in ("sizes", "letters", "n")]
    sizes, letters, n = (b"".join(p) for p in parts)
    return Words(np.frombuffer(letters, np.uint8), np.frombuffer(sizes, "<u4").astype(np.int64)), np.frombuffer(n, "<i8"), letters


def _meet(table: pa.Table) -> pa.Table:
    cells: dict[tuple, tuple[list[int], list[int]]] = {}
    for at, (block, row, column, home) in enumerate(zip(*(table[c].to_pylist() for c in ("block", "row", "column", "home")))):
        cells.setdefault((block, row, column), ([], []))[0 if home else 1].append(at)
    word: list[str] = []
    other: list[str] = []
    other_n: list[np.ndarray] = []

    def add(x, i, y, j) -> None:
        (xs, x_n, x_letters), (ys, y_n, y_letters) = x, y
        x_end, y_end = xs.ends, ys.ends
        a = [x_letters[e - n : e].decode("latin-1") for e, n in zip(x_end[i].tolist(), xs.sizes[i].tolist())]
        b = [y_letters[e - n : e].decode("latin-1") for e, n in zip(y_end[j].tolist(), ys.sizes[j].tolist())]
        word.extend(a + b)
        other.extend(b + a)
        other_n.extend([y_n[j], x_n[i]])

    for (_, _, column), (homes, comers) in cells.items():
        if not homes:
            continue
        x = _unpacked(table, homes)
        if column == 0:
            for i, j in near_pairs(x[0], x[0], same=True):
                add(x, i, x, j)
        if comers:
            y = _unpacked(table, comers)
            for i, j in near_pairs(x[0], y[0]):
                add(x, i, y, j)
    numbers = np.concatenate(other_n or [np.zeros(0, np.int64)])
    return pa.Table.from_arrays([pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(numbers, pa.int64())], ["word", "other", "other_n"])


def variant_links(words: DataFrame, folder: str, tile_words: int = TILE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, other, other_n`` of all words that are one edit apart, in both directions; ``words`` (word, n) is a stored table.

    A block's words travel together, one row for each block they go to. Blocks with more than ``tile_words`` words are cut into tiles, and
    tiles of two blocks, or of one, meet in tasks of their own.
    """
    spark = words.sparkSession

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LETTERS), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_PLACE[Words.of([w.encode("latin-1") for w in batch.column("word").to_pylist()]).letters], minlength=len(LETTERS))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(LETTERS)), pa.int32()), pa.array(total)], ["letter", "k"])

    weights = np.zeros(len(LETTERS))
    for row in words.select("word").mapInArrow(weigh, "letter INT, k LONG").groupBy("letter").agg(F.sum("k").alias("k")).collect():
        weights[row["letter"]] = row["k"]  # one number for each letter
    n_words = words.count()
    group = letter_groups(weights, n_words, block_words)
    placed = with_blocks(words, group)
    sizes = placed.groupBy("block").agg(F.ceil(F.count("*") / tile_words).alias("tiles"))
    sizes.where("tiles > 1").write.parquet(f"{folder}/wide")
    wide = spark.read.schema("block BINARY, tiles LONG").parquet(f"{folder}/wide")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tiles in zip(batch.column("block").to_pylist(), batch.column("tiles").to_pylist()):
                targets = [block, *neighbours(block)]
                yield pa.RecordBatch.from_arrays([pa.array(targets, pa.binary()), pa.array([tiles] * len(targets), pa.int64())], ["block", "columns"])

    reach = wide.mapInArrow(reached, "block BINARY, columns LONG").groupBy("block").agg(F.max("columns").alias("columns"))
    own_tile = F.pmod(F.xxhash64("word"), F.coalesce("tiles", F.lit(1))).cast("int")
    shipped = n_words * copies(int(group.max()) + 1)
    sent = _messages(placed.join(wide, "block", "left").withColumn("tile", own_tile), max(1, -(-n_words // 20_000)))
    met = sent.join(wide, "block", "left").join(reach, "block", "left").withColumns(
        {"tiles": F.coalesce("tiles", F.lit(1)).cast("int"), "columns": F.coalesce("columns", F.lit(1)).cast("int")}
    )
    # a tile at home waits in every column, a comer goes to all rows of its column; one of the same block to the rows before its own
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    rows = F.when(F.col("home"), F.array("tile")).when(F.col("own"), all_of(F.col("tile"))).otherwise(all_of(F.col("tiles")))
    columns = F.when(F.col("home"), all_of(F.col("columns"))).otherwise(F.array("tile"))
    tiled = met.withColumn("row", F.explode(rows)).withColumn("column", F.explode(columns))
    dealt = tiled.withColumn("part", F.pmod(F.xxhash64("block", "row", "column"), F.lit(max(1, -(-shipped // 200_000)))))
    return dealt.select("part", "block", "row", "column", "home", "sizes", "letters", "n").groupBy("part").applyInArrow(_meet, NEAR)


# forms


def roots_of(forms: DataFrame, folder: str) -> DataFrame:
    """``word, root`` for ``word, form``: the last of the chain of forms, by doubling; each round is written below ``folder``.

    A form occurs at least twice as often as its word, so chains are short and have no rings.
    """
    spark = forms.sparkSession
    schema = "word STRING, root STRING"
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{folder}/0")
    turn = 0
    while True:
        now = spark.read.schema(schema).parquet(f"{folder}/{turn}")
        onward = now.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        moved = now.join(onward, now["root"] == onward["at"], "left")
        turn += 1
        moved.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")).write.parquet(f"{folder}/{turn}")
        stored = spark.read.schema(f"{schema}, moved BOOLEAN").parquet(f"{folder}/{turn}")
        if stored.where("moved").isEmpty():
            return stored.drop("moved")


def spelling_variants(docs: DataFrame, folder: str, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs`` (doc_id, text).

    Words are maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z in lower case, as altered by :func:`misspelt`, of at least five code points and
    three occurrences ``n``. Two are near if one edit leads from one to the other. A word's form is its near word of largest ``n``
    (the smallest in code-point order of several), if that occurs at least twice as often; ``root`` is where forms lead. Null texts
    have no words; a row without an id has the empty text as id; repeated rows count each. Other columns are not read. No words give no rows. Tables between
    are written below ``folder``, which all executors must share; ``options`` go to :func:`variant_links`.
    """
    spark = docs.sparkSession
    count_words(docs).write.parquet(f"{folder}/words")
    words = spark.read.schema("word STRING, n LONG").parquet(f"{folder}/words")
    links = variant_links(words, folder, **options)
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    judged = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    judged.write.parquet(f"{folder}/judged")
    judged = spark.read.schema("word STRING, n LONG, n_near LONG, form STRING, form_n LONG").parquet(f"{folder}/judged")
    roots = roots_of(judged.where("form IS NOT NULL"), f"{folder}/roots")
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    """The same by its definition, for small tests: form, root, n, near words, n of the form."""
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near: dict[str, list[str]] = {}
    by_hole: dict[tuple, list[str]] = {}
    for w in n:  # near words share what is left without one letter, or with one made a hole
        for i in range(len(w)):
            by_hole.setdefault((w[:i] + "?" + w[i + 1 :],), []).append(w)
        for shorter in {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys():
            near.setdefault(w, []).append(shorter)
            near.setdefault(shorter, []).append(w)
    for same in by_hole.values():
        for w in same:
            near.setdefault(w, []).extend(x for x in same if x != w)
    form = {}
    for w in n:
        best = min(near.get(w, []), key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near.get(w, [])), n[form[w]] if form[w] else None)
    return out
