"""A Merkle manifest of a dataset as persistent trees.

Every row is a leaf; the leaves of a tree (one for each source) are numbered by key with a range-partitioned sort, and every
4096 consecutive ones are a block that one task reduces by three levels of sixteen children. The blocks'
top nodes are the leaves of the next round, until a tree has one node; the trees' roots then make one more tree. On
the way down each block learns the siblings above it, a few hundred bytes a level, and from then on needs
nothing else: proofs and versions of its leaves are made where they lie.

A changed leaf makes a version of the tree by path copying: only its ancestors are made anew, first within the
block and then along the block's own path above, and every other node is shared with the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32
_HEX = 2 * _SIZE
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# leaves


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else byte count, colon and value."""
    as_text = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in as_text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def document_leaves(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``tree, key, leaf, changed``: the tree's name (empty for null, else behind ``=``), and the leaf after tampering, null where there is none."""
    columns = {f: F.col(f) for f in fields}
    altered = {**columns, text: lower_ascii(F.col(text))}
    return docs.select(
        F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string"))).alias("tree"),
        F.col(key).cast("long").alias("key"),
        leaf_digest(list(columns.values())).alias("leaf"),
        F.when(tampered, leaf_digest(list(altered.values()))).alias("changed"),
    )


# numbering


def number_leaves(leaves: DataFrame, order: Sequence[str], folder: str) -> DataFrame:
    """``leaves`` with ``position``, counted within each ``tree`` by the columns of ``order`` (nulls first).

    Rows are range-partitioned and sorted by tree and order, and counted as they stream by. Only the first tree of a partition can have begun in an
    earlier one, so all that is gathered is one number for each partition.
    """
    spark = leaves.sparkSession
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            at = []
            for tree in batch.column("tree").to_pylist():
                if tree != now:
                    now, seen = tree, 0
                at.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    schema = StructType(leaves.schema.fields).add("pid", IntegerType()).add("at", LongType())
    ranged.mapInArrow(count, schema).write.parquet(folder)
    counted = spark.read.schema(schema).parquet(folder)
    ends = counted.groupBy("pid").agg(F.min("tree").alias("first"), F.max(F.struct("tree", "at")).alias("last"))
    starts, tree, held = [], None, 0
    for row in sorted(ends.collect(), key=lambda r: r["pid"]):
        before = held if row["first"] == tree else 0
        starts.append((row["pid"], row["first"], before))
        tree, held = row["last"]["tree"], row["last"]["at"] + 1 + (before if row["first"] == row["last"]["tree"] else 0)
    offsets = spark.createDataFrame(starts, "pid INT, first STRING, before LONG")
    position = F.col("at") + F.when(F.col("tree") == F.col("first"), F.col("before")).otherwise(0)
    return counted.join(F.broadcast(offsets), "pid").select(*leaves.columns, position.alias("position"))


# blocks


def _parent(children: bytes) -> bytes:
    return hashlib.sha256(children).hexdigest().encode()


class BlockTree:
    """The nodes of one block, as hex text level by level; it is never altered.

    A block that is its whole tree ends at one node, any other after ``LEVELS`` levels.
    """

    def __init__(self, leaves: bytes, whole: bool) -> None:
        """``leaves``: digests in a row, as bytes."""
        self.rows = [leaves.hex().encode()]
        for _ in range(LEVELS):
            row = self.rows[-1]
            if whole and len(row) == _HEX:
                break
            self.rows.append(b"".join(_parent(row[i : i + RUN * _HEX]) for i in range(0, len(row), RUN * _HEX)))

    @property
    def top(self) -> bytes:
        return bytes.fromhex(self.rows[-1].decode())

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """What stands before and after leaf ``i`` and each of its ancestors in their runs."""
        out = []
        for row in self.rows[:-1]:
            start, at = i // RUN * RUN * _HEX, i * _HEX
            out.append((row[start:at], row[at + _HEX : start + RUN * _HEX]))
            i //= RUN
        return out


def copied_path(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> list[bytes]:
    """A version in which this leaf (hex) stands among its original siblings: its new ancestors, the root last."""
    path, node = [], leaf
    for before, after in siblings:
        node = _parent(before + node + after)
        path.append(node)
    return path


def _packed_path(siblings: list[tuple[bytes, bytes]]) -> bytes:
    """Siblings in a few bytes more than their digests: how many stand before and after, then they."""
    return b"".join(
        bytes([len(before) // _HEX, len(after) // _HEX]) + bytes.fromhex((before + after).decode()) for before, after in siblings
    )


def _unpacked_path(packed: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(packed):
        before, after = packed[at], packed[at + 1]
        held = packed[at + 2 : at + 2 + (before + after) * _SIZE].hex().encode()
        out.append((held[: before * _HEX], held[before * _HEX :]))
        at += 2 + (before + after) * _SIZE
    return out


PACKED = "tree STRING, block LONG, n INT, top BINARY, nodes BINARY, keys ARRAY<LONG>, changed ARRAY<BINARY>"
_PACKED = pa.schema(
    [
        ("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("top", pa.binary()), ("nodes", pa.binary()),
        ("keys", pa.list_(pa.int64())), ("changed", pa.list_(pa.binary())),
    ]
)


def _is_whole(block: int, n: int) -> bool:
    return block == 0 and n < BLOCK


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("position")
    block, n = table["block"][0].as_py(), table.num_rows
    nodes = b"".join(table["leaf"].to_pylist())
    top = BlockTree(nodes, _is_whole(block, n)).top
    row = [table["tree"][0].as_py(), block, n, top, nodes, table["key"].to_pylist(), table["changed"].to_pylist()]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED)], schema=_PACKED)


def build_rounds(numbered: DataFrame, folder: str) -> list[DataFrame]:
    """The blocks of every round, the leaves' first; each is written below ``folder``. A round's full blocks are the next one's leaves."""
    spark = numbered.sparkSession
    rounds: list[DataFrame] = []
    nodes = numbered
    while True:
        placed = nodes.withColumn("block", F.expr(f"position div {BLOCK}"))
        placed.groupBy("tree", "block").applyInArrow(_pack, PACKED).write.parquet(f"{folder}/{len(rounds)}")
        packed = spark.read.schema(PACKED).parquet(f"{folder}/{len(rounds)}")
        rounds.append(packed)
        rising = packed.where(f"block > 0 OR n = {BLOCK}")
        if rising.isEmpty():
            return rounds
        none = [F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("changed")]
        nodes = rising.select("tree", F.col("top").alias("leaf"), *none, F.col("block").alias("position"))


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, top`` of every tree."""
    ended = [r.where(f"block = 0 AND n < {BLOCK}").select("tree", "top") for r in rounds]
    out = ended[0]
    for frame in ended[1:]:
        out = out.unionByName(frame)
    return out


PATHS = "tree STRING, block LONG, path BINARY, top BINARY"


def _paths_below(blocks: DataFrame) -> DataFrame:
    """The paths of the nodes of ``tree, block, n, nodes, path, top``, each of which is a block of the round below."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, n, nodes, above, top in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "nodes", "path", "top"))):
                own = BlockTree(nodes, _is_whole(block, n))
                paths = [_packed_path(own.siblings(i)) + above for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * n), pa.array([block * BLOCK + i for i in range(n)], pa.int64()), pa.array(paths, pa.binary()), pa.array([top] * n, pa.binary())],
                    ["tree", "block", "path", "top"],
                )

    return blocks.select("tree", "block", "n", "nodes", "path", "top").mapInArrow(descend, PATHS)


def block_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tree, block, path, top`` of the first round's blocks: the siblings from each block's top to the last root.

    ``tops`` has ``tree, path, top``: each tree's root and the siblings above it.
    """
    paths = None
    for packed in reversed(rounds):
        ended = packed.where(f"block = 0 AND n < {BLOCK}").select("tree", "block").join(tops, "tree").select("tree", "block", "path", "top")
        here = ended if paths is None else paths.unionByName(ended)
        if packed is rounds[0]:
            return here
        paths = _paths_below(packed.join(here, ["tree", "block"]).select("tree", "block", "n", "nodes", "path", here["top"]))


RESULT = "key LONG, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, copied ARRAY<STRING>"


def _proved(blocks: DataFrame) -> DataFrame:
    """Proof and version of every leaf of ``block, n, nodes, keys, changed, path, subroot, root``."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "n", "nodes", "keys", "changed", "path", "subroot", "root")
        for batch in batches:
            for block, n, nodes, keys, changed, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in names)):
                own, above = BlockTree(nodes, _is_whole(block, n)), _unpacked_path(path)
                proof_above = b"".join(before + after for before, after in above)
                rows = []
                for i in range(n):
                    leaf, within = own.rows[0][i * _HEX : (i + 1) * _HEX], own.siblings(i)
                    proof = hashlib.sha256(b"".join(before + after for before, after in within) + proof_above).hexdigest()
                    now = leaf if changed[i] is None else changed[i].hex().encode()
                    inner = copied_path(now, within)
                    version = inner + copied_path(inner[-1] if inner else now, above)
                    folded = (version[-1] if version else now).decode()
                    rows.append((leaf.decode(), proof, folded, None if changed[i] is None else [v.decode() for v in version]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([subroot.hex()] * n, pa.string()),
                        pa.array([root.hex()] * n, pa.string()), pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    ],
                    ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied"],
                )

    return blocks.mapInArrow(prove, RESULT)


def manifest(leaves: DataFrame, folder: str) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, copied, verified`` of every row of ``leaves`` (tree, key, leaf, changed).

    Leaves of a tree ascend by key, null first; rows of one key follow each other by digest. Every sixteen consecutive nodes (fewer
    at the end) become the SHA-256 of their hex digests until one is left, the subroot; subroots, ordered by the tree's name in
    UTF-8 bytes, become the root in the same way. ``proof_sha256`` is the digest of all siblings from the leaf to the root, left
    to right; ``folded_root`` the root that the leaf, or what ``changed`` has in its place, leads to with them; ``copied`` the
    nodes of a changed leaf's version that are not shared with the original, root last. No leaves give no rows.
    Everything between is written below ``folder``, which all executors must share.
    """
    spark = leaves.sparkSession
    schema = "tree STRING, key LONG, leaf BINARY, changed BINARY"
    leaves.select("tree", "key", "leaf", "changed").write.parquet(f"{folder}/leaves")
    stored = spark.read.schema(schema).parquet(f"{folder}/leaves")
    rounds = build_rounds(number_leaves(stored, ["key", "leaf"], f"{folder}/numbered"), f"{folder}/rounds")

    roots = tree_roots(rounds).select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit(None).cast("long").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("changed")
    )
    numbered = number_leaves(roots, ["name"], f"{folder}/roots")
    upper = build_rounds(numbered, f"{folder}/upper")
    whole = tree_roots(upper).select("tree", F.lit(b"").alias("path"), "top")
    above = block_paths(upper, whole)
    first = upper[0].join(above, ["tree", "block"]).select("tree", "block", "n", "nodes", "path", above["top"])
    named = _paths_below(first).select(F.col("block").alias("position"), "path", F.col("top").alias("root"))
    tops = numbered.join(named, "position").select(F.col("name").alias("tree"), "path", F.col("leaf").alias("top"), "root")
    tops.write.parquet(f"{folder}/tops")
    tops = spark.read.schema("tree STRING, path BINARY, top BINARY, root BINARY").parquet(f"{folder}/tops")

    block_paths(rounds, tops.drop("root")).write.parquet(f"{folder}/paths")
    paths = spark.read.schema(PATHS).parquet(f"{folder}/paths").withColumnRenamed("top", "subroot")
    root = tops.select(F.max("root").alias("root")).first()["root"]
    blocks = rounds[0].drop("top").join(paths, ["tree", "block"]).withColumn("root", F.lit(root))
    proved = _proved(blocks.select("block", "n", "nodes", "keys", "changed", "path", "subroot", "root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def brute_force(rows: list[tuple[str | None, int | None, bytes, bytes | None]]) -> list[tuple]:
    """The same by its definition, for small tests: ``(key, leaf, subroot, root, proof, folded root)`` of source, key, leaf and changed leaf."""

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hashlib.sha256("".join(out[-1][i : i + 16]).encode()).hexdigest() for i in range(0, len(out[-1]), 16)])
        return out

    def walk(tree: list[list[str]], i: int, node: str) -> tuple[str, str]:
        proof = ""
        for row in tree[:-1]:
            run = row[i // 16 * 16 : i // 16 * 16 + 16]
            others = run[: i % 16] + run[i % 16 + 1 :]
            proof += "".join(others)
            run[i % 16] = node
            node, i = hashlib.sha256("".join(run).encode()).hexdigest(), i // 16
        return proof, node

    sources = sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in sources}
    trees = {s: levels([r[2].hex() for r in members[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, (_, key, leaf, changed) in enumerate(members[s]):
            low, node = walk(trees[s], i, (changed or leaf).hex())
            high, folded = walk(top, at, node)
            out.append((key, leaf.hex(), trees[s][-1][0], top[-1][0], hashlib.sha256((low + high).encode()).hexdigest(), folded))
    return out
