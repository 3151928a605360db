"""Exact Jaccard join of n-gram sets by signature trees.

Two sets that are similar enough share one of their first n-grams in any order common to all; so
documents meet under the n-grams of such a prefix, rare ones first. Under each n-gram a tree is laid over the
documents: its nodes hold the OR of their members' token bitmaps, the range of set sizes and the least
number of bits. Pairs of nodes are descended together and dropped once the largest overlap that
bitmaps and sizes allow is too small, or all their members are linked already. What is left is verified on
the sets. Groups of near copies are linked through one central member first, so their pairs are never listed.
Large groups are dealt to several tasks: every member meets the centre where it lies, then parts of the group meet in pairs,
except where all members are linked already.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicflow.llm import blocks
from topicflow.llm.common import BASES, mix, slices, texts_as_bytes, window_hashes, word_bounds, word_hashes
from topicflow.llm.components import connected_components

GRAM, PERCENT = 5, 80
BITMAP_WORDS, FANOUT = 8, 8
#: Share of the blocks above which an n-gram is moved to the end of the order of n-grams.
HOT_SHARE = 0.25
#: Documents of an n-gram that one task holds; larger groups are dealt to several.
GROUP = 512
#: Prefixes are looked up by so much more than their own length, to have rare n-grams in reserve.
RESERVE = 1.5
#: Node pairs that are held at once.
FRONTIER = 1 << 18


def shingle_sets(texts: list[bytes], gram: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text, A-Z in lower case."""
    texts = [t.lower() for t in texts]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    begin = 0
    for end in bounds.tolist():
        own = words[begin:end]
        if len(own) == 0:
            yield np.zeros(0, np.uint64)
        elif len(own) < gram:
            yield window_hashes(own, len(own), BASES[3]) ^ np.uint64(len(own))
        else:
            yield np.unique(window_hashes(own, gram, BASES[3]))
        begin = end


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    with np.errstate(over="ignore"):
        low = int(mix(grams + BASES[0]).sum(dtype=np.uint64)) if len(grams) else 0
        high = int(mix(grams ^ BASES[1]).sum(dtype=np.uint64)) if len(grams) else 0
    return low - (1 << 64) * (low >> 63), high - (1 << 64) * (high >> 63)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many n-grams of a set must be looked up: all but the overlap it needs, and one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def reserve_length(n: int, percent: int = PERCENT) -> int:
    return min(n, int(prefix_length(n, percent) * RESERVE) + 1)


def least_common(n: int, percent: int = PERCENT) -> int:
    """N-grams of its reserve that a set of this size has in common with the reserve of any similar one.

    A prefix longer by ``k`` than it must be has ``k + 1`` n-grams in common with the other's; the
    smallest similar set has the shortest reserve.
    """
    smallest = -(-percent * n // 100)
    return reserve_length(smallest, percent) - prefix_length(smallest, percent) + 1


def least_overlap(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Common n-grams that two sets need, given the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def bitmap(grams: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
    bits[(grams >> np.uint64(7)) % np.uint64(BITMAP_WORDS * 64)] = 1
    return np.packbits(bits).tobytes()


def sketch(grams: np.ndarray) -> bytes:
    """A bitmap of eight bits for each n-gram, rounded up to a power of two: nearly as sharp as the set at an eighth of its size."""
    width = 8 << max(3, int(len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[grams & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def may_be_similar(x: bytes, n_x: int, y: bytes, n_y: int, percent: int = PERCENT) -> bool:
    """False only if the sketches leave too little room for the overlap; the wider one is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    common = int(np.bitwise_count(a & b).sum())
    missing_a, missing_b = int(np.bitwise_count(a).sum()) - common, int(np.bitwise_count(b).sum()) - common
    return min(n_x - missing_a, n_y - missing_b) >= least_overlap(np.int64(n_x + n_y), percent)


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1).astype(np.int64)


class SignatureTree:
    """Levels of nodes over sets, leaves first; the last level has one node."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, linked: np.ndarray, sides: np.ndarray | None = None) -> None:
        """With ``sides``, only sets of unlike sides are paired."""
        count = _count_bits(bits)
        sides = np.arange(len(sizes)) if sides is None else sides
        level = {"small": sizes, "large": sizes, "bits": bits, "count": count, "from": linked, "to": linked, "left": sides, "right": sides}
        self.levels = [level]
        while len(level["small"]) > 1:
            at = np.arange(0, len(level["small"]), FANOUT)
            level = {
                "small": np.minimum.reduceat(level["small"], at),
                "large": np.maximum.reduceat(level["large"], at),
                "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0),
                "count": np.minimum.reduceat(level["count"], at),
                "from": np.minimum.reduceat(level["from"], at),
                "to": np.maximum.reduceat(level["to"], at),
                "left": np.minimum.reduceat(level["left"], at),
                "right": np.maximum.reduceat(level["right"], at),
            }
            self.levels.append(level)

    def possible(self, depth: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold two sets that are similar and not linked yet."""
        t = self.levels[depth]
        apart = (t["from"][i] != t["from"][j]) | (t["from"][i] != t["to"][i]) | (t["from"][j] != t["to"][j])
        apart &= (t["left"][i] != t["left"][j]) | (t["left"][i] != t["right"][i]) | (t["left"][j] != t["right"][j])
        fits = (percent * t["small"][i] <= 100 * t["large"][j]) & (percent * t["small"][j] <= 100 * t["large"][i])
        common = _count_bits(t["bits"][i] & t["bits"][j])
        most = np.minimum(
            t["large"][i] - np.maximum(t["count"][i] - common, 0), t["large"][j] - np.maximum(t["count"][j] - common, 0)
        )
        return apart & fits & (most >= least_overlap(t["small"][i] + t["small"][j], percent))

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves by dual traversal, a bounded number of node pairs at a time."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            depth, i, j = stack.pop()
            if len(i) > FRONTIER:
                half = len(i) // 2
                stack += [(depth, i[:half], j[:half]), (depth, i[half:], j[half:])]
                continue
            ok = self.possible(depth, i, j, percent) & ((i != j) | (depth > 0))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if depth == 0:
                yield i, j
                continue
            below = len(self.levels[depth - 1]["small"])
            steps = np.arange(FANOUT)
            ci = (i[:, None, None] * FANOUT + steps[None, :, None]).repeat(FANOUT, 2).ravel()
            cj = (j[:, None, None] * FANOUT + steps[None, None, :]).repeat(FANOUT, 1).ravel()
            real = (ci < below) & (cj < below) & (ci <= cj)
            stack.append((depth - 1, ci[real], cj[real]))


def centre_of(sizes: np.ndarray, bits: np.ndarray) -> int:
    """The member nearest to the bits that most members have."""
    each = np.unpackbits(bits.view(np.uint8), axis=1)
    most = each.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int(np.argmin((each != most).sum(axis=1)))


POSTINGS = "kind STRING, token LONG, doc_id LONG, n LONG, bits BINARY, first BINARY"
_POSTINGS_NAMES = ["kind", "token", "doc_id", "n", "bits", "first"]
_POSTINGS_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
#: How many of a document's posted n-grams go with each of its postings, and what fills a shorter list.
FIRST, _NONE = 6, np.uint64((1 << 64) - 1)
PAIRS = "a LONG, b LONG"


def first_of(tokens: np.ndarray) -> bytes:
    """The smallest posted n-grams of a document, always as many."""
    return np.concatenate([np.sort(tokens)[:FIRST], np.full(max(0, FIRST - len(tokens)), _NONE)]).astype(np.uint64).tobytes()


def met_elsewhere(token: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs meet under another n-gram as well that is the one to report them.

    That is the smallest that both lists hold. Pairs whose lists hold none in common are reported
    wherever they meet, so none is lost; copies nearly always have one.
    """
    out = np.empty(len(x), bool)
    for s in range(0, len(x), 1 << 14):
        a, b = x[s : s + (1 << 14)], y[s : s + (1 << 14)]
        held = (a[:, :, None] == b[:, None, :]).any(axis=2)
        least = np.where(held, a, _NONE).min(axis=1)
        out[s : s + (1 << 14)] = (least != _NONE) & (least != np.uint64(token))
    return out


def _frame(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


CLASSES = "doc_id LONG, text_key LONG, block INT, n LONG, low LONG, high LONG"


def set_classes(docs: DataFrame, layout: blocks.Layout, gram: int) -> DataFrame:
    """``doc_id, text_key, block, n, low, high`` of every document: the digest of its set, and a hash and the place of its text."""
    name = layout.block
    names = ["doc_id", "text_key", "block", "n", "low", "high"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_as_bytes(part.column("text")), gram)
                rows = [(len(s), *set_digest(s)) for s in sets]
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), part.column(name).cast(pa.int32()), *columns], schema=pa.schema(list(zip(names, kinds)))
                )

    return layout.docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", name).mapInArrow(digests, CLASSES)


def _postings(layout: blocks.Layout, chosen: DataFrame, gram: int, percent: int, hot_blocks: int | None) -> DataFrame:
    """Prefix n-grams that several sets share, with size and bitmap, and the sets of those documents.

    ``chosen`` (doc_id, block, low, high, vertex) names the one document of each distinct set, the set's digest and its number among
    the vertices of the links, which is what postings have as ``doc_id``; without the last three, the ids number the sets. N-grams in more than
    ``hot_blocks`` blocks, or else ``HOT_SHARE`` of them, are the last to be posted.
    """
    hot_blocks = int(HOT_SHARE * layout.n_blocks) if hot_blocks is None else hot_blocks
    n_parts = layout.n_parts
    if "vertex" not in chosen.columns:
        chosen = chosen.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long"), "vertex": F.col("doc_id")})
    wanted = chosen.select(
        "block", F.lit(0).alias("phase"), F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.lit(None).cast("binary").alias("bits"), "low", "high", "vertex"
    )

    def sets_of(table: pa.Table, vertices: dict[int, dict[tuple[int, int], int]]) -> list[tuple[int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        docs, texts = table["doc_id"].to_pylist(), texts_as_bytes(table["text"].combine_chunks())
        rows = Counter(docs)
        picked = [i for i, d in enumerate(docs) if d in vertices]
        start = 0
        while start < len(picked):
            end, size = start, 0
            while end < len(picked) and (end == start or size < 1 << 20):
                size += len(texts[picked[end]])
                end += 1
            for i, grams in zip(picked[start:end], shingle_sets([texts[i] for i in picked[start:end]], gram)):
                if len(grams):
                    own = vertices[docs[i]]
                    # where an id has several rows, the digest tells which of their sets are meant
                    vertex = own.get(set_digest(grams)) if rows[docs[i]] > 1 else next(iter(own.values()))
                    if vertex is not None:
                        held.setdefault(vertex, grams)
            start = end
        return sorted(held.items())

    def reserve(grams: np.ndarray) -> np.ndarray:
        return grams[: reserve_length(len(grams), percent)]

    def vertices_of(answers: pa.Table) -> dict[int, dict[tuple[int, int], int]]:
        out: dict[int, dict[tuple[int, int], int]] = {}
        for p, i, low, high, vertex in zip(*(answers[c].to_pylist() for c in ("phase", "id", "low", "high", "vertex"))):
            if p == 0:
                out.setdefault(i, {})[low, high] = vertex
        return out

    def look_up(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = sets_of(table, vertices_of(answers)) if table.num_rows else []
        tokens = np.concatenate([reserve(g) for _, g in sets] or [np.zeros(0, np.uint64)])
        keys, counts = np.unique(tokens, return_counts=True)
        return blocks.key_table(blocks.key_rows(block, keys, None, counts > 1, n_parts))

    def emit(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = sets_of(table, vertices_of(answers)) if table.num_rows else []
        keys = np.unique(np.concatenate([reserve(g) for _, g in sets] or [np.zeros(0, np.uint64)]))
        shared, hot = blocks.answered(answers, 1, keys, n_parts, 2)
        rows: list[tuple] = []
        for doc_id, grams in sets:
            first = reserve(grams)
            at = np.searchsorted(keys, first)
            # similar sets have so many n-grams of their reserves in common that all but one of these may be left
            # out at the end of an order that all sets share: the hot ones, then those with large fingerprints
            left_out = least_common(len(grams), percent) - 1
            common = first[shared[at]]
            tokens = common[np.argsort(hot[at][shared[at]], kind="stable")][: max(0, len(common) - left_out)]
            if len(tokens):
                signature, smallest = bitmap(grams), first_of(tokens)
                rows += [("token", t, doc_id, len(grams), signature, smallest) for t in tokens.view(np.int64).tolist()]
                rows.append(("set", None, doc_id, len(grams), grams.tobytes(), None))
                rows.append(("sketch", None, doc_id, len(grams), sketch(grams), None))
        return _frame(rows, _POSTINGS_NAMES, _POSTINGS_KINDS)

    keys = blocks.ask(layout, wanted, look_up, blocks.KEYS)
    none = F.lit(None).cast("long")
    replies = blocks.shared_keys(keys, 1, hot_blocks).withColumns({"id": none, "low": none, "high": none, "vertex": none})
    return blocks.ask(layout, wanted.unionByName(replies), emit, POSTINGS)


def _bits(column: pa.ChunkedArray | pa.Array, width: int = BITMAP_WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def wide_tokens(postings: DataFrame, group: int) -> DataFrame:
    """``token, held`` of the n-grams that more than ``group`` documents post."""
    return postings.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > group)


def _wide_stars(postings: DataFrame, wide: DataFrame, percent: int, group: int) -> DataFrame:
    """Members of large groups that may be similar to their group's centre; no task holds a group.

    The centre is that of a sample of about ``group`` members, the same ones wherever the same documents meet.
    """
    own = postings.join(wide, "token")

    def centre(table: pa.Table) -> pa.Table:
        order = np.argsort(table["doc_id"].to_numpy())
        at = int(order[centre_of(table["n"].to_numpy()[order], _bits(table["bits"])[order])])
        return table.slice(at, 1).select(["token", "doc_id", "n", "bits"]).rename_columns(["token", "b", "n_b", "bits_b"])

    sampled = own.where(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("held") / F.lit(group))) == 0)
    centres = sampled.groupBy("token").applyInArrow(centre, "token LONG, b LONG, n_b LONG, bits_b BINARY")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = np.concatenate([batch.column(c).to_numpy() for c in ("n", "n_b")])
                bits = np.concatenate([_bits(batch.column(c)) for c in ("bits", "bits_b")])
                at = np.arange(batch.num_rows)
                ok = SignatureTree(sizes, bits, np.arange(len(sizes))).possible(0, at, at + len(at), percent)
                yield batch.select(["doc_id", "b"]).rename_columns(["a", "b"]).filter(pa.array(ok))

    met = own.join(centres, "token").where("doc_id != b")
    return met.select("doc_id", "n", "bits", "b", "n_b", "bits_b").mapInArrow(near, PAIRS)


def _tiles(labelled: DataFrame, wide: DataFrame, group: int) -> DataFrame:
    """Large groups as tiles of two parts of about ``group`` members each: ``low, high, side`` next to the postings.

    Members of the largest component make parts of their own, which need not meet each other; if
    there are no others, the group is done. All other pairs of members meet in one tile.
    """
    own = labelled.join(wide.select("token"), "token")
    kinds = own.groupBy("token", "linked").agg(F.count("*").alias("k"))
    shape = kinds.groupBy("token").agg(
        F.max_by("linked", F.struct("k", -F.col("linked"))).alias("main"),
        F.ceil(F.max("k") / F.lit(group)).alias("mains"),
        F.ceil((F.sum("k") - F.max("k")) / F.lit(group)).alias("others"),
    )
    dealt = own.join(shape.where("others > 0"), "token")
    is_main, spread = F.col("linked") == F.col("main"), F.xxhash64("doc_id")
    part = F.when(is_main, F.pmod(spread, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spread, F.greatest("others", F.lit(1))))
    facing = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    met = dealt.withColumn("own_part", part).withColumn("facing", F.explode(facing))
    return met.select(
        *labelled.columns, F.least("own_part", "facing").alias("low"), F.greatest("own_part", "facing").alias("high"),
        (F.col("own_part") > F.col("facing")).cast("int").alias("side"),
    )


def _candidates(postings: DataFrame, wide: DataFrame, n_parts: int, percent: int, group: int, stars: bool) -> DataFrame:
    """Pairs that may be similar and have different ``linked``; with ``stars`` only those with their groups' centres.

    ``wide`` has the n-grams whose groups are too large for one task.
    """

    def groups(table: pa.Table) -> pa.Table:
        places = [table[c].to_numpy() for c in ("token", "low", "high")]
        order = np.lexsort((table["doc_id"].to_numpy(), *places[::-1]))
        token, low, high = (c[order] for c in places)
        docs, side = table["doc_id"].to_numpy()[order], table["side"].to_numpy()[order]
        sizes, linked = table["n"].to_numpy()[order], table["linked"].to_numpy()[order]
        bits, firsts = _bits(table["bits"])[order], _bits(table["first"], FIRST)[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(token))
        found_a, found_b, seen = [], [], set()
        for s, e in zip(begins.tolist(), ends.tolist()):
            if e - s < 2 or (linked[s:e] == linked[s]).all():
                continue
            n, b, c, d = sizes[s:e], bits[s:e], linked[s:e], docs[s:e]
            if stars:
                members = d.tobytes()
                if members in seen:  # the same documents under another n-gram
                    continue
                seen.add(members)
                at = centre_of(n, b)
                tree = SignatureTree(n, b, c)
                others = np.arange(e - s)
                ok = tree.possible(0, others, np.full(e - s, at), percent) & (others != at)
                found_a.append(d[others[ok]])
                found_b.append(np.full(int(ok.sum()), d[at]))
            else:
                near = np.lexsort((n, c, side[s:e]))
                tree = SignatureTree(n[near], b[near], c[near], None if low[s] == high[s] else side[s:e][near])
                own = firsts[s:e][near]
                for i, j in tree.pairs(percent):
                    here = ~met_elsewhere(int(token[s]) % (1 << 64), own[i], own[j])
                    found_a.append(d[near[i[here]]])
                    found_b.append(d[near[j[here]]])
        a = np.concatenate(found_a or [np.zeros(0, np.int64)])
        b = np.concatenate(found_b or [np.zeros(0, np.int64)])
        if not stars:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    whole = {"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long"), "side": F.lit(0)}
    narrow = postings.join(wide, "token", "left_anti").withColumns(whole)
    found = narrow.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(n_parts))).groupBy("part").applyInArrow(groups, PAIRS)
    if not stars:
        tiles = _tiles(postings, wide, group)
        tiled = tiles.withColumn("part", F.xxhash64("token", "low", "high")).groupBy("part").applyInArrow(groups, PAIRS)
        return found.unionByName(tiled).distinct()
    # of the centres that a document met, the one it met under most n-grams
    counted = found.unionByName(_wide_stars(postings, wide, percent, group)).groupBy("a", "b").agg(F.count("*").alias("met"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("met", -F.col("b"))).alias("b"))


def _checked(pairs: DataFrame, sides: DataFrame, same) -> DataFrame:
    """The pairs for which ``same(x, n_x, y, n_y)`` holds of what ``sides`` (doc_id, n, bits) has for either."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("x", "n_x", "y", "n_y")]
            keep = [same(x.as_py(), n.as_py(), y.as_py(), m.as_py()) for x, n, y, m in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    xs = sides.select(F.col("doc_id").alias("a"), F.col("n").alias("n_x"), F.col("bits").alias("x"))
    ys = sides.select(F.col("doc_id").alias("b"), F.col("n").alias("n_y"), F.col("bits").alias("y"))
    return pairs.join(xs, "a").join(ys, "b").select("a", "b", "x", "n_x", "y", "n_y").mapInArrow(check, PAIRS)


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets really are similar: ``100 * common >= percent * union``.

    Sketches, an eighth of the sets' size, go first; whole sets then meet for what is left, nearly all of it links.
    """

    def near(x: bytes, n_x: int, y: bytes, n_y: int) -> bool:
        return may_be_similar(x, n_x, y, n_y, percent)

    def similar(x: bytes, n_x: int, y: bytes, n_y: int) -> bool:
        small, large = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        common = int((large[at] == small).sum())
        return 100 * common >= percent * (n_x + n_y - common)

    return _checked(_checked(pairs, sketches, near), sets, similar)


class SimilarSets(NamedTuple):
    """What the join finds, as tables below its folder."""

    #: every row: doc_id, text_key, n, low, high
    classes: DataFrame
    #: every distinct set that some id has: low, high, n, doc_id (the least) and its number ``vertex``
    chosen: DataFrame
    #: similar sets: a, b
    links: DataFrame


def similar_sets(docs: DataFrame, folder: str, gram: int, percent: int, hot_blocks: int | None, block_bytes: int, group: int) -> SimilarSets:
    """Classes of equal sets, and links between those with a similarity of ``percent`` %."""
    spark = docs.sparkSession
    layout = blocks.lay_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes)
    set_classes(docs, layout, gram).write.parquet(f"{folder}/classes")
    classes = spark.read.schema(CLASSES).parquet(f"{folder}/classes")
    least = classes.where("n > 0").groupBy("low", "high", "n").agg(F.min_by(F.struct("doc_id", "block"), "doc_id").alias("first"))
    numbered = least.where("first.doc_id IS NOT NULL").select("low", "high", "n", "first.*", F.monotonically_increasing_id().alias("vertex"))
    numbered.write.parquet(f"{folder}/chosen")
    chosen = spark.read.schema("low LONG, high LONG, n LONG, doc_id LONG, block INT, vertex LONG").parquet(f"{folder}/chosen")
    _postings(layout, chosen.drop("n"), gram, percent, hot_blocks).write.partitionBy("kind").parquet(f"{folder}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    tokens = stored.where("kind = 'token'").drop("kind")
    sketches, sets = (stored.where(F.col("kind") == kind).select("doc_id", "n", "bits") for kind in ("sketch", "set"))

    wide_tokens(tokens, group).write.parquet(f"{folder}/wide")
    wide = spark.read.schema("token LONG, held LONG").parquet(f"{folder}/wide")

    alone = tokens.withColumn("linked", F.col("doc_id"))
    verified(_candidates(alone, wide, layout.n_parts, percent, group, True), sketches, sets, percent).write.parquet(f"{folder}/links/turn=0")
    links = spark.read.schema(PAIRS).parquet(f"{folder}/links/turn=0")
    known = connected_components(links, f"{folder}/first")
    # stored, as narrow groups, shapes and tiles of wide ones all read it
    tokens.join(known, tokens["doc_id"] == known["vertex"], "left").select(*tokens.columns, F.coalesce("component", "doc_id").alias("linked")).write.parquet(
        f"{folder}/labelled"
    )
    labelled = spark.read.schema(f"{POSTINGS}, linked LONG").parquet(f"{folder}/labelled").drop("kind")
    verified(_candidates(labelled, wide, layout.n_parts, percent, group, False), sketches, sets, percent).write.parquet(f"{folder}/links/turn=1")
    links = spark.read.schema(PAIRS).parquet(f"{folder}/links/turn=0", f"{folder}/links/turn=1")
    return SimilarSets(classes.drop("block"), chosen.drop("block"), links)


def _same_id(found: SimilarSets) -> DataFrame:
    """Links ``a, b`` between the sets of each id that has several."""
    digest = F.struct("low", "high", "n")
    named = found.classes.where("n > 0 AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min(digest).alias("one"), F.max(digest).alias("other")).where("one != other").select(F.col("doc_id").alias("id"), "one")
    rows = named.join(several, named["doc_id"] == several["id"]).select("id", "one", "low", "high", "n").distinct()
    numbers = found.chosen.select("low", "high", "n", "vertex")
    left = rows.join(numbers, ["low", "high", "n"]).select("id", F.col("vertex").alias("b"), "one.*")
    return left.join(numbers.withColumnRenamed("vertex", "a"), ["low", "high", "n"]).where("a != b").select("a", "b")


def _named(found: SimilarSets, links: DataFrame, folder: str) -> DataFrame:
    """``low, high, n, doc_id, group``: every distinct set, its least id, and the number of what links lead to."""
    components = connected_components(links, folder).withColumnRenamed("vertex", "own")
    joined = found.chosen.join(components, found.chosen["vertex"] == components["own"], "left")
    return joined.select("low", "high", "n", "doc_id", F.coalesce("component", "vertex").alias("group"))


def similar_documents(
    docs: DataFrame, folder: str, gram: int = GRAM, percent: int = PERCENT, hot_blocks: int | None = None, block_bytes: int = blocks.BLOCK_BYTES,
    group: int = GROUP,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Documents are linked if their n-gram sets have a Jaccard similarity of at least ``percent`` %;
    ``component_id`` is the least id that links lead to. Sets of texts with fewer words than ``gram`` are their
    whole sequence; null and wordless texts have none and link with nothing. Rows with equal sets are
    one class from the start, however many. Rows without an id take their class's component, null
    if no row of it has one; repeated rows each give a row, and all sets of one id are linked, in whatever order its rows come; other
    columns are not read. Intermediate tables are
    written below ``folder``, which all executors must share.
    """
    found = similar_sets(docs, folder, gram, percent, hot_blocks, block_bytes, group)
    named = _named(found, found.links.unionByName(_same_id(found)), f"{folder}/last")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    joined = named.drop("doc_id").join(least, "group").drop("group")
    return found.classes.join(joined, ["low", "high", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def first_of_groups(docs: DataFrame, folder: str, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key`` of the rows to keep of ``docs`` so that no two are similar; ``text_key`` is the text's ``xxhash64``.

    Of each group of rows that links join, the one with the least id stays, of several texts of that id the one with the least ``text_key``; unlike
    texts of one id are groups of their own. Rows without a word link with nothing and all stay. Rows without an id are not judged
    and not returned; repeated rows give one.
    """
    found = similar_sets(docs, folder, gram, percent, None, blocks.BLOCK_BYTES, GROUP)
    named = _named(found, found.links, f"{folder}/last").drop("doc_id")
    rows = found.classes.where("doc_id IS NOT NULL")
    grouped = rows.where("n > 0").join(named, ["low", "high", "n"])
    firsts = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    return firsts.unionByName(rows.where("n = 0").select("doc_id", "text_key").distinct())


def brute_force(rows: list[tuple[int, str | None]], gram: int = GRAM, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The same by its definition, for small tests."""
    upper = bytes(range(65, 91))
    sets = {}
    for i, text in rows:
        words = (text or "").encode().translate(bytes.maketrans(upper, upper.lower())).split()
        sets[i] = {tuple(words[k : k + gram]) for k in range(max(1, len(words) - gram + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}
