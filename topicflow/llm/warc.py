"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. A reader's task gets a range of bytes, looks for the
bytes that begin a gzip member, accepts a candidate only if it inflates to a WARC header (of any length), and
owns the records that start within its range, reading beyond the end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

MAGIC, _MARK = b"\x1f\x8b\x08", b"WARC/"
SPLIT_BYTES = 8 << 20
_CHUNK = 1 << 20
RECORDS = (
    "page_id LONG, target_uri STRING, record_type STRING, payload_digest STRING, payload_bytes LONG, refers_to LONG, "
    "payload BINARY, path STRING, offset LONG"
)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1, as WARC headers carry it (there with ``sha1:`` in front)."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads the one with the largest id stays whole.

    Payloads are compared by SHA-256 and length, in a shuffle of digests with map-side combining
    that no number of copies can burden; payloads shorter than ``least_bytes`` never refer.
    Null html is an empty payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn(
        "content", F.concat(F.unhex(F.sha2("html", 256)), F.encode(F.octet_length("html").cast("string"), "utf-8"))
    )
    largest = keyed.groupBy("content").agg(F.max("page_id").alias("kept_id"))
    refers = F.when(
        (F.col("kept_id") != F.col("page_id")) & (F.octet_length("html") >= least_bytes), F.col("kept_id")
    )
    return keyed.join(largest, "content", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit carries its payload's digest and length, not the payload."""
    body = payload if refers_to is None else b""
    target = "".join((url or "").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(whole) + press.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as one archive per task; returns ``path, n_records, n_bytes``.

    A task writes under a name of its own attempt. The list of archives is stored through Spark's
    commit, which names each task's successful attempt only, so files that a lost executor or a
    second attempt leaves behind are never read. Empty tasks write nothing.
    """
    spark = records.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")))
            for page_id, url, html, refers_to in rows:
                if out is None:
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0])
                    out = store.open_output_stream(path, compression=None)
                data = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"]
            )

    listed = f"{folder}/archives"
    schema = "path STRING, n_records LONG, n_bytes LONG"
    records.mapInArrow(write, schema).write.parquet(listed)
    return spark.read.schema(schema).parquet(listed)


class _Window:
    """Bytes of a file from a moving start, fetched chunk by chunk."""

    def __init__(self, file, size: int, at: int) -> None:
        self.file, self.size, self.at, self.data = file, size, at, b""

    def more(self) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        got = self.file.read(min(_CHUNK, self.size - end))
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _inflate(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The content of the member at ``start`` in the window and its length there, or None if it is not a WARC record.

    A candidate is given up as soon as its first bytes are not a record's; a record's header may be as long as it likes.
    """
    press, parts, head, at = zlib.decompressobj(31), [], b"", start
    while not press.eof:
        if at >= len(window.data) and not window.more():
            return None
        piece = window.data[at : at + _CHUNK]
        try:
            parts.append(press.decompress(piece))
        except zlib.error:
            return None
        at += len(piece)
        if len(head) < len(_MARK):
            head += parts[-1][: len(_MARK) - len(head)]
            if not _MARK.startswith(head):
                return None
    content = b"".join(parts)
    if not content.startswith(_MARK) or b"\r\n\r\n" not in content:
        return None
    return content, at - len(press.unused_data) - start


def _parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in ``[start, end)``: offset, header fields and block."""
    window = _Window(file, size, start)
    while window.at < end:
        at = window.data.find(MAGIC)
        if at < 0 or window.at + at >= end:
            if at >= 0:
                return
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        found = _inflate(window, at)
        if found is None:
            window.drop(at + 1)
            continue
        content, used = found
        yield (window.at + at, *_parsed(content))
        window.drop(at + used)


def _id(urn: str) -> int | None:
    tail = urn.rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``archives`` (path, n_bytes), in ranges of ``split_bytes``, one row each (see ``RECORDS``).

    The digest and length of a response are computed from what was read, those of a revisit come
    from its header. Bytes that belong to no record are skipped; no archives give no rows.
    """
    starts = F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start")
    ranges = archives.where("n_bytes > 0").select("path", "n_bytes", starts)
    cores = archives.sparkSession.sparkContext.defaultParallelism
    total = archives.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes)).alias("n")).first()["n"] or 1
    dealt = ranges.repartition(max(cores, int(total) // 4, 1), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "start"))):
                store, path = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, fields, block in scan_range(file, size, start, min(size, start + split_bytes)):
                        kind = fields.get("warc-type")
                        if kind == "revisit":
                            digest, n, block = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(fields.get("x-payload-bytes", 0)), None
                        else:
                            digest, n = payload_digest(block), len(block)
                        refers = _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                        rows.append((_id(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, digest, n, refers, block, name, offset))
                        held += len(block or b"")
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return dealt.mapInArrow(read, RECORDS)
