"""Questions that blocks of documents put to all others.

Documents are dealt to blocks of a bounded number of bytes by a hash of the whole row, so copies
of one text with different ids spread evenly. A block reduces what it holds to distinct 64-bit
keys and sends each range of keys to one task; that task sees a key once per block, however
often it occurs, and sends one bit per key back. So no key, hot or not, gathers more than one
entry per block anywhere, and texts are shuffled once: every step reads the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicflow.llm.common import bytes_total

BLOCK_BYTES = 8 << 20
#: Text bytes whose keys one task gathers.
PART_BYTES = 4 << 20
ANSWERS = "block INT, phase INT, part INT, bits BINARY"


@dataclass(frozen=True)
class Layout:
    """Documents with the column ``block``, and the numbers of key ranges and blocks."""

    docs: DataFrame
    block: str
    n_parts: int
    n_blocks: int


def lay_out(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> Layout:
    """Deal documents to blocks. Rows that are equal in id and text share a block, any others need not."""
    total = bytes_total(docs, "text")
    n_blocks = max(1, math.ceil(total / block_bytes))
    name = "block"
    while name in docs.columns:
        name += "_"
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    return Layout(docs.withColumn(name, dealt), name, max(1, math.ceil(total / part_bytes)), n_blocks)


def parts_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """Range of each key; it does not fall as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def cut_by_part(sorted_keys: np.ndarray, n_parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the ranges that sorted keys fall in."""
    if not len(sorted_keys):
        return []
    parts = parts_of(sorted_keys, n_parts)
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    ends = np.append(starts[1:], len(parts))
    return [(int(parts[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def distinct(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each sorted entry, first of each group): equal keys and checks are one group."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if checks is not None:
        differ = np.zeros(len(keys), bool)
        differ[1:] = checks[order[1:]] != checks[order[:-1]]
        if (differ & ~new).any():  # two windows that share a key
            order = np.lexsort((checks, keys))
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def key_rows(block: int, keys: np.ndarray, checks: np.ndarray | None, several: np.ndarray, n_parts: int) -> list[tuple]:
    """Messages about sorted distinct keys; ``several``: the block itself holds the key more than once."""
    return [
        (
            part,
            block,
            keys[s:e].tobytes(),
            b"" if checks is None else checks[s:e].astype(np.uint32).tobytes(),
            np.packbits(several[s:e]).tobytes(),
        )
        for part, s, e in cut_by_part(keys, n_parts)
    ]


KEYS = "part INT, block INT, keys BINARY, checks BINARY, several BINARY"
_KEYS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("several", pa.binary())])


def key_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KEYS_ARROW)], schema=_KEYS_ARROW)


def answer_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["block", "phase", "part", "bits"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def shared_keys(messages: DataFrame, phase: int, hot_blocks: int | None = None) -> DataFrame:
    """Which keys occur more than once, as bits in the order of each block's own keys.

    With ``hot_blocks``, a second run of bits tells which keys more blocks than that hold.
    """

    def decide(table: pa.Table) -> pa.Table:
        blocks, part = table["block"].to_pylist(), table["part"][0].as_py()
        raw = table["keys"].to_pylist()
        sizes = [len(k) // 8 for k in raw]
        keys = np.frombuffer(b"".join(raw), np.uint64)
        raw_checks = b"".join(table["checks"].to_pylist())
        checks = np.frombuffer(raw_checks, np.uint32) if raw_checks else None
        several = np.concatenate(
            [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table["several"].to_pylist(), sizes)]
        ).astype(bool)
        order, group, first = distinct(keys, checks)
        count = np.diff(np.append(first, len(keys)))
        shared = count > 1
        np.logical_or.at(shared, group[several[order]], True)
        bits = np.empty(len(keys), bool)
        bits[order] = shared[group]
        hot = np.zeros(len(keys), bool)
        if hot_blocks is not None:
            hot[order] = (count > hot_blocks)[group]
        ends = np.cumsum(sizes)
        return answer_table(
            [
                (b, phase, part, np.packbits(np.concatenate([bits[e - n : e], hot[e - n : e]] if hot_blocks is not None else [bits[e - n : e]])).tobytes())
                for b, n, e in zip(blocks, sizes, ends)
            ]
        )

    return messages.groupBy("part").applyInArrow(decide, ANSWERS)


def of_parts(answers: pa.Table, phase: int) -> dict[int, bytes]:
    """The bits that came back in a phase, by the part that sent them."""
    rows = zip(answers["phase"].to_pylist(), answers["part"].to_pylist(), answers["bits"])
    return {part: bits.as_py() for p, part, bits in rows if p == phase}


def answered(answers: pa.Table, phase: int, keys: np.ndarray, n_parts: int, runs: int = 1) -> list[np.ndarray]:
    """The bits that came back for a block's sorted keys, in ``runs`` arrays."""
    found = of_parts(answers, phase)
    out = [np.zeros(len(keys), bool) for _ in range(runs)]
    for part, s, e in cut_by_part(keys, n_parts):
        bits = np.unpackbits(np.frombuffer(found[part], np.uint8), count=runs * (e - s)).astype(bool)
        for i in range(runs):
            out[i][s:e] = bits[i * (e - s) : (i + 1) * (e - s)]
    return out


def ask(layout: Layout, answers: DataFrame | None, step: Callable, schema) -> DataFrame:
    """Run ``step(block, documents, answers)`` on every block; it returns an Arrow table."""
    name = layout.block
    if answers is None:
        return layout.docs.groupBy(name).applyInArrow(lambda table: step(table[name][0].as_py(), table, None), schema)

    def both(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = docs[name][0].as_py() if docs.num_rows else replies["block"][0].as_py()
        return step(block, docs, replies)

    return layout.docs.groupBy(name).cogroup(answers.groupBy("block")).applyInArrow(both, schema)
