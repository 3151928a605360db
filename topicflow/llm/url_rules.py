"""URL rules by a sort-merge range join.

A host is turned round (``org.example.``), so that a rule covers one interval of keys: its own
and all that begin with it. Pages and rules are dealt to ranges of keys; a rule goes to every
range that its interval meets. Within a range both are read in key order, and a stack holds the
rules whose interval has begun and not ended: the ancestors of the page's host.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Keys per range that the driver samples to find bounds; their number is bounded by the ranges.
SAMPLED_PER_RANGE = 40
LAST = "\U0010ffff"


def _after_scheme(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``: subdomains share the prefix, look-alikes do not."""
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))).otherwise("")


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        part = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "is_page", "page_id", "host", "path", "verdict")]
            out: list[tuple] = []
            for p, key, is_page, page_id, host, path, verdict in zip(*columns):
                if p != part:
                    stack, part = [], p
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, paths, lengths = stack[-1]
                    if path not in paths or verdict == "block":
                        paths[path] = (f"{host}{path}", verdict)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, paths, lengths in stack:
                    for n in lengths:
                        found = paths.get(path[:n]) if n <= len(path) else None
                        if found:
                            if best is None or len(found[0]) >= len(best[0]):
                                best = found
                            break
                out.append((page_id, host, path, *(best or (None, default))))
            names = ["page_id", "host", "path", "rule", "verdict"]
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names
            )

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Host, path, the rule that decides and its verdict, one row for each page.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the path begins with the rule's; the longest (host and path together) wins, of
    equally long ones that with the longer host, and of two verdicts for one rule ``block``.
    ``default`` is the verdict where none fits.

    A null url and one without ``://`` have an empty host and path and fit no rule. Rules without
    a host are ignored, a null path counts as empty. Repeated pages each give a row; other
    columns are not read. A range's bounds are pairs of key and page id, so the pages of a host,
    or copies of one url, spread over as many ranges as their number calls for.
    """
    spark = pages.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of("url").alias("host"), path_of("url").alias("path")
    ).withColumn("key", reversed_host(F.col("host")))
    fraction_key = F.struct(F.xxhash64("page_id").alias("h"), "key", F.coalesce("page_id", F.lit(-1)).alias("id"))
    # the rows with the smallest hashes are a bounded sample, the same on every run
    wanted = ranges * SAMPLED_PER_RANGE
    sample = sorted(
        (r["s"]["key"], r["s"]["id"]) for r in keyed.select(fraction_key.alias("s")).orderBy("s.h").limit(wanted).collect()
    )
    step = max(1, len(sample) // ranges)
    bounds = sorted(set(sample[step::step]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            parts = [bisect_right(bounds, (k, -1 if i is None else i)) for k, i in zip(keys, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (part, i)
                for i, key in enumerate(batch.column("key").to_pylist())
                for part in range(bisect_left(bounds, (key,)), bisect_right(bounds, (key + LAST,)) + 1)
            ]
            taken = batch.take(pa.array([i for _, i in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), *taken.columns], ["part", *batch.schema.names])

    stream = "part INT, key STRING, is_page BOOLEAN, page_id LONG, host STRING, path STRING, verdict STRING"
    columns = ("key", "is_page", "page_id", "host", "path", "verdict")
    placed = keyed.select(
        "key", F.lit(True).alias("is_page"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    ).mapInArrow(place, stream)
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = (
        rules.select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host IS NOT NULL AND host != ''")
        .withColumn("key", reversed_host(F.col("host")))
        .select("key", F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )
    assert tuple(listed.columns) == columns
    merged = placed.unionByName(listed.mapInArrow(spread, stream))
    ordered = merged.repartition(ranges, "part").sortWithinPartitions("part", "key", "is_page")
    return ordered.mapInArrow(_sweep(default), "page_id LONG, host STRING, path STRING, rule STRING, verdict STRING")
