"""The best few rows of every group without gathering a group.

Each task keeps the best ``k`` it has seen of a group, some partial lists meet under a salt, and those few meet in the end. So what any
task holds of a group is bounded by ``k``, the salts and the number of tasks, however large the group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32


def best_of_lists(rows: DataFrame, group: str, order: Sequence[str | Column], k: int, salts: int = SALTS) -> DataFrame:
    """``group``, ``rank`` and the columns of ``rows``, the first ``k`` of each group by ``order``.

    Meant for the lists that tasks have cut to ``k`` already; they meet under a salt before they meet as a whole.
    """
    own = [c for c in rows.columns if c != group]
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"order_{i}") for i, c in enumerate(order)]
    entry = F.struct(*keys, F.struct(*own).alias("row"))
    first = lambda entries: F.slice(F.array_sort(entries), 1, k)
    salted = rows.select(group, entry.alias("entry"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    partial = salted.groupBy(group, "salt").agg(first(F.collect_list("entry")).alias("entries"))
    best = partial.groupBy(group).agg(first(F.flatten(F.collect_list("entries"))).alias("entries"))
    each = best.select(group, F.posexplode("entries").alias("pos", "entry"))
    return each.select(group, *(F.col(f"entry.row.{c}").alias(c) for c in own), (F.col("pos") + 1).alias("rank"))


def first_keys(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """``group`` and ``key`` of the ``k`` smallest distinct keys of each group; a null group is one, null keys are left out."""
    group_type, key_type = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            seen: dict = {}
            for g, x in zip(batch.column(group).to_pylist(), batch.column(key).to_pylist()):
                if x is not None:
                    seen.setdefault(g, set()).add(x)
            for g, keys in seen.items():
                held[g] = heapq.nsmallest(k, keys.union(held.get(g, ())))
            schema = batch.schema
        if held:
            pairs = [(g, x) for g, keys in held.items() for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(c).type) for i, c in enumerate((group, key))], [group, key])

    lists = rows.select(group, key).mapInArrow(smallest, f"`{group}` {group_type}, `{key}` {key_type}")
    return best_of_lists(lists.distinct(), group, [key], k).select(group, key)
