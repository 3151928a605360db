"""Large JSON arrays of objects, read by many tasks.

The text source reads a file in byte ranges with ``}`` as the end of a line, so ranges are as large as Spark
makes them, wherever the file lies. Whether a range begins within a string, and how deep, follows from the ranges before it: a
first pass gives for each range how many quotes it holds and how it changes the depth, both if it begins within a string and if not;
running sums over a file's ranges (a row each) then give every range its start. With that a second pass cuts the elements. Only
what stands before the first and behind the last end of an element in a range is shuffled, to be joined to its other part. Where
ranges are small, a task reads many of them, so that their number costs rows and not tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

END = "}"
_QUOTE, _ESCAPE = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
#: Bytes of ranges that a task may read, and tasks a core that are left in any case.
TASK_BYTES, TASKS_PER_CORE = 128 << 20, 4
#: What may stand between elements.
_BETWEEN = b" \t\r\n,["


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that open or close a string: those after an even number of backslashes."""
    found = data == _QUOTE
    slashes = data == _ESCAPE
    if not slashes.any():
        return found
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slashes, -1, at))  # of the bytes up to here, the last that is no backslash
    before = np.concatenate([[-1], last_other[:-1]])
    return found & ((at - 1 - before) % 2 == 0)


def _within(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Which bytes stand within a string, for a stretch that begins ``inside`` one (1) or not (0); whether it ends in one."""
    quotes = np.cumsum(_quotes(data))
    return (quotes + inside) % 2 == 1, int(quotes[-1] + inside) % 2 if len(quotes) else inside


def _stretches(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, bytes, bool]]:
    """Consecutive lines of one range as bytes, each with its end: range, bytes, and whether a new range begins."""
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "start", *columns))))
        values = batch.column("value").cast(pa.binary()).to_pylist()
        begin = 0
        while begin < len(keys):
            end, size = begin + 1, len(values[begin])
            while end < len(keys) and keys[end] == keys[begin] and size < 1 << 20:
                size += len(values[end])
                end += 1
            yield keys[begin], b"}".join(values[begin:end]) + b"}", keys[begin] != now
            now, begin = keys[begin], end


SUMMARY = "file STRING, start LONG, quotes LONG, outside LONG, inside LONG"


def _summaries(lines: DataFrame) -> DataFrame:
    """One row for each range: quotes, and the change of depth if it begins outside or inside of a string."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for key, raw, new in _stretches(batches):
            if new:
                rows.append([*key, 0, 0, 0])
            data = np.frombuffer(raw, np.uint8)
            own = rows[-1]
            quotes = _quotes(data)
            odd = (np.cumsum(quotes) + own[2]) % 2 == 1
            steps = _STEP[data]
            own[2] += int(quotes.sum())
            own[3] += int(steps[~odd].sum())
            own[4] += int(steps[odd].sum())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "start", "quotes", "outside", "inside"])

    return lines.mapInArrow(scan, SUMMARY)


def _starts(summaries: DataFrame) -> DataFrame:
    """``file, start, in_string, depth``: the state in which each range begins."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = summaries.withColumn("in_string", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    deep = known.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return deep.select("file", "start", "in_string", "depth")


PIECES = "file STRING, start LONG, part INT, ended BOOLEAN, piece BINARY"
#: An element within its range, what stands before the first end in a range, what stands behind the last.
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _pieces(lines: DataFrame) -> DataFrame:
    """Elements that lie within their range, and the parts of others; ``lines`` come with the state of their range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        key, held, inside, depth, first = None, [], 0, 0, True

        def rows() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["file", "start", "part", "ended", "piece"])

        def close() -> None:
            if key is not None:
                out.append((*key, _HEAD if first else _TAIL, False, b"".join(held)))

        for (file, start, in_string, deep), raw, new in _stretches(batches, "in_string", "depth"):
            if new:
                close()
                key, held, inside, depth, first = (file, start), [], in_string, deep, True
            data = np.frombuffer(raw, np.uint8)
            hidden, inside = _within(data, inside)
            depths = depth + np.cumsum(np.where(hidden, 0, _STEP[data]))
            depth = int(depths[-1])
            begin = 0
            for end in (np.flatnonzero((data == ord(END)) & ~hidden & (depths == 1)) + 1).tolist():
                piece = b"".join([*held, raw[begin:end]])
                out.append((*key, _HEAD if first else _WHOLE, True, piece))
                size += len(piece)
                held, begin, first = [], end, False
            held.append(raw[begin:])
            if size > 4 << 20:
                yield rows()
                out.clear()
                size = 0
        close()
        if out:
            yield rows()

    return lines.mapInArrow(cut, PIECES)


def _range_bytes(spark: SparkSession) -> int:
    """The session's largest range; a size as Spark writes it, such as 128MB or 262144."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0)


def _in_few_tasks(lines: DataFrame) -> DataFrame:
    """The ranges in tasks of about ``TASK_BYTES``, but some for each core; no range is moved or cut."""
    spark, ranges = lines.sparkSession, lines.rdd.getNumPartitions()
    tasks = max(-(-ranges * _range_bytes(spark) // TASK_BYTES), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < ranges else lines


def read_json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element``: the elements of JSON arrays of objects, as text, in UTF-8.

    ``path`` names files, each one valid JSON array whose elements are objects, on one line or many; a file without elements gives no rows. Files
    are split into ranges as Spark splits any text.
    """
    lines = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    lines = _in_few_tasks(lines)
    starts = _starts(_summaries(lines))  # a row for each range, that is, for some dozen MB
    placed = lines.join(F.broadcast(starts), ["file", "start"]).select("file", "start", "in_string", "depth", "value")
    pieces = _pieces(placed)
    whole = pieces.where(F.col("part") == _WHOLE).select("file", "piece")
    # a tail opens an element, which the next head that has an end closes
    in_order = Window.partitionBy("file").orderBy("start", "part")
    parts = pieces.where(F.col("part") != _WHOLE).withColumn("element", F.sum((F.col("part") == _TAIL).cast("int")).over(in_order))
    pieced = parts.groupBy("file", "element").agg(
        F.max("ended").alias("ended"), F.array_sort(F.collect_list(F.struct("start", "part", "piece"))).alias("pieces")
    )
    text = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda joined, p: F.concat(joined, p["piece"]))
    joined = pieced.where("ended").select("file", text.alias("piece"))
    element = F.ltrim(F.col("piece").cast("string"), F.lit(_BETWEEN.decode()))
    return whole.unionByName(joined).select("file", element.alias("element"))


def write_json_arrays(elements: DataFrame, path: str, column: str = "element") -> None:
    """Write a column of JSON objects as files that each hold one array, a file for each task."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            texts = [e for e in batch.column(column).to_pylist() if e is not None]
            out = [("[" if first and not i else ",") + e for i, e in enumerate(texts)]
            first = first and not texts
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    elements.select(column).mapInArrow(lines, "value STRING").write.text(path)
