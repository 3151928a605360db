"""Removal of lines that many documents hold, as bitmaps of the lines that stay.

Every long enough line becomes a 128-bit hash next to its document and position. Hashes are range-partitioned
and sorted by document and position within a hash, so a pass over a range sees a line's documents one after the other,
the one that keeps it first. Hashes with a large share of all rows are few, whatever the input's size: they are taken out
before and decided where their rows lie, so what a task holds of one hash is bounded. What comes out
is a bitmap for each document that loses lines, not its text. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST_CHARS, LEAST_DOCS = 20, 3
#: A hash is heavy above this share of all rows, so at most as many hashes as its inverse are broadcast.
HEAVY_SHARE = 1e-5
#: Rows of a hash that any task can hold; no hash with fewer is heavy.
LIGHT_ROWS = 256
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines a word of a bitmap tells about.
_WORD = 64
#: A row without an id counts as the document before all others.
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """What makes lines the same: no white space at the ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text_key, doc, pos, h1, h2`` of every line whose key has ``least_chars`` code points."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least_chars)
    return keyed.select(
        "doc_id", "text_key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "pos",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def _lost_heavy(lines: DataFrame, heavy: DataFrame, least_docs: int) -> DataFrame:
    """Lost lines of the heavy hashes: all but those of the largest document, decided next to the broadcast hashes."""
    met = lines.join(F.broadcast(heavy), ["h1", "h2"])
    # dealt by hash and document, so no hash meets in one task
    held = met.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    return met.where("doc < last").join(F.broadcast(held), ["h1", "h2"], "left_semi")


def _lost_light(lines: DataFrame, heavy: DataFrame, least_docs: int) -> DataFrame:
    """Lost lines of all other hashes: ranges of hashes, sorted by document from the largest down, in one pass."""
    light = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti")
    ranged = light.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    same = Window.partitionBy("h1", "h2")
    turn = F.dense_rank().over(same.orderBy(F.desc("doc")))
    ranked = ranged.withColumn("turn", turn).withColumn("docs", F.max("turn").over(same))
    return ranked.where((F.col("turn") > 1) & (F.col("docs") >= least_docs))


def repeated_lines(docs: DataFrame, folder: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, text_key, n_dropped, keep_bits`` of every document that loses lines.

    A line goes if its key (see :func:`line_key`) has at least ``least_chars`` code points and is found in at least
    ``least_docs`` documents, of which this one is not the largest ``doc_id``; a document that holds the
    key several times keeps or loses all of them. ``keep_bits`` maps a word's number to 64 bits, bit ``i`` of word ``w`` telling
    whether line ``64 * w + i`` stays; a word that loses no line is left out. Rows are told apart by id and
    text (``text_key``, its 64-bit hash), so repeated rows share a bitmap; rows of one id are one document, rows without an id
    together are one before all others. Null and empty texts are one empty line and lose none. Only
    ``doc_id`` and ``text`` are read. Hashes are written below ``folder``, which all executors must share.
    """
    spark = docs.sparkSession
    hashed_lines(docs, least_chars).write.parquet(f"{folder}/lines")
    lines = spark.read.schema("doc_id LONG, text_key LONG, doc LONG, pos INT, h1 LONG, h2 LONG").parquet(f"{folder}/lines")
    most = max(LIGHT_ROWS, int(lines.count() * HEAVY_SHARE))
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
    counts.where(F.col("n") > most).select("h1", "h2", "last").write.parquet(f"{folder}/heavy")
    heavy = spark.read.schema("h1 LONG, h2 LONG, last LONG").parquet(f"{folder}/heavy")
    names = ["doc_id", "text_key", "pos"]
    lost = _lost_heavy(lines, heavy, least_docs).select(names).unionByName(_lost_light(lines, heavy.select("h1", "h2"), least_docs).select(names))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % _WORD)
    words = lost.groupBy("doc_id", "text_key", F.expr(f"pos div {_WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    return words.groupBy("doc_id", "text_key").agg(
        F.sum(F.bit_count("lost")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep_bits"),
    )


def without_repeated_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row of ``docs``, given the bitmaps of :func:`repeated_lines`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    found = bitmaps.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "n_dropped", "keep_bits")
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["own_id"]) & (texts["text_key"] == found["own_key"]), "left")

    def stays(line: Column, pos: Column) -> Column:
        word = F.try_element_at("keep_bits", F.floor(pos / _WORD).cast("int"))
        return word.isNull() | (F.call_function("shiftright", word, pos % _WORD).bitwiseAND(F.lit(1)) == 1)

    kept = F.array_join(F.filter(split_lines(F.col("text")), stays), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def brute_force(rows: list[tuple[int | None, str | None]], least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> list[tuple[int, int, str]]:
    """The same by its definition, for small tests: lines, lost lines and kept text of each row."""
    lower = str.maketrans(_UPPER, _UPPER.lower())
    key = lambda line: line.strip(_SPACE).translate(lower)
    holders: dict[str, set[int]] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(_NO_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = _NO_ID if doc_id is None else doc_id
        lost = [len(k) >= least_chars and len(holders[k]) >= least_docs and max(holders[k]) != own for k in map(key, lines)]
        out.append((len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost) if not gone)))
    return out
