"""Token counts behind a digest cache.

Texts are reduced to digests, joined to stored counts of the same tokenizer, and only distinct
texts without a count are encoded. Their counts are appended to the cache.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

CACHE = "tokenizer BINARY, content BINARY, n_tokens LONG"
#: Texts of these characters alone are cut alike by both libraries (see the tests); all others,
#: and texts that hold a special token, go to the tokenizer file itself.
PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-ɏ]*")


def tokenizer_digest(path: str) -> bytes:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def normalised(text: str | Column) -> Column:
    """The content that is counted: the text itself, null as empty. Anything more could change counts."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def content_digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def encoder(path: str, ranks_path: str | None = None):
    """A function from texts to their token counts, as the library of the file gives them.

    ``ranks_path`` names the same vocabulary as ranks: most texts then take a faster encoder
    that yields the same tokens.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    if ranks_path is None:
        return lambda texts: [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if PLAIN.fullmatch(text) and not any(s in text for s in specials):
            return len(fast.encode_ordinary(text))
        return len(whole.encode(text, add_special_tokens=False))

    return lambda texts: [count(t) for t in texts]


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, cache_dir: str, tokenizer: str, ranks: str | None = None, context: int = 1024
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Counts are of whole texts without begin, end or other added tokens. Null texts count as
    empty: 0 bytes, 0 tokens. Repeated rows and ids each give a row; further columns are not
    read. The cache holds one row per tokenizer and content. A run that fails after the append
    finds its counts there the next time; duplicate appends of two runs are harmless.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("text")).withColumn(
        "content", content_digest("text")
    )
    misses = distinct_misses(keyed, read_cache(spark, cache_dir), version)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, ranks)
        for batch in batches:
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.binary()), batch.column("content"), pa.array(counts, pa.int64())],
                ["tokenizer", "content", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_dir)
    stored = read_cache(spark, cache_dir).where(F.col("tokenizer") == F.lit(version))
    counts = stored.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(normalised("text")).cast("long").alias("n_bytes"),
        content_digest("text").alias("content"),
    )
    return slim.join(counts, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit")
    )


def distinct_misses(keyed: DataFrame, cache: DataFrame, version: bytes) -> DataFrame:
    """One row with ``content, text`` for each distinct text that has no count yet.

    Digests are deduplicated first, with map-side combining, so a text with very many copies
    crosses the shuffle once per task; texts move only for the row that stands for them.
    """
    known = cache.where(F.col("tokenizer") == F.lit(version)).select("content").distinct()
    first = keyed.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    chosen = first.join(known, "content", "left_anti")
    # rows without an id can stand for a text too, hence the null-safe comparison; copies that share an id
    # leave one row only, since a text is encoded once per digest
    same = keyed["content"].eqNullSafe(chosen["content"]) & keyed["doc_id"].eqNullSafe(chosen["doc_id"])
    return keyed.join(chosen, same, "left_semi").select("content", "text")
