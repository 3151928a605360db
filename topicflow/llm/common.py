"""Helpers that several operators share: Arrow stages, word splitting and hashing of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes that part words: space and 0x09 to 0x0D. bytes.split() parts at exactly these.
SEPARATORS = b"\t\n\x0b\x0c\r "
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240229)
#: One random odd 64-bit number per byte value, the letters of the polynomial hashes below.
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = _rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be no column's."""
    while name in columns:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, budget: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``budget`` bytes; a longer text is a part of its own."""
    sizes = np.diff(np.asarray(text_offsets(batch.column(column))))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_offsets(column: pa.Array) -> np.ndarray:
    """Start of each text in the column's bytes, and the end of the last."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Texts in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, int(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


_LETTER = np.ones(256, bool)
_LETTER[list(SEPARATORS)] = False
#: Longest stretch of bytes hashed at once; it bounds the memory for texts of any length.
_STRETCH = 1 << 20


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of every word: polynomials over byte codes, by prefix sums.

    Bytes are taken in stretches that end between words, so a text's length does not
    bear on memory (a single word longer than a stretch is hashed whole).
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + _STRETCH, "right"))
        last = max(last, first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        power = powers(BASES[0], high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[low:high]] * power, out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        back = powers(inverse(BASES[0]), high - low)
        out[first:last] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * BASES[1])
        first = last
    return out


def window_hashes(codes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A fingerprint of every ``width`` consecutive codes: polynomials in ``base``, by doubling."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, block, size, step = None, 0, codes, 1, int(base)
    left = width
    while left:
        if left & 1:
            part = block[done : done + n]
            total = part if total is None else total * np.uint64(step) + part
            done += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * np.uint64(step) + block[size:]
            size, step = size * 2, step * step % (1 << 64)
    return mix(total)


def bytes_total(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column, one small row to the driver."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)
