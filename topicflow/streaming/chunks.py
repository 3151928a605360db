"""Enrichment in chunks of a bounded number of papers, each a step that a stopped run need not repeat.

Papers that arrive are landed once: what is pending is written as files of at most ``chunk_rows`` papers, however large the
files were that they came in. A chunk is so many landed files. A second stream takes many chunks at a time and works through them in
waves: the first chunk of a run alone, then two, four and so on up to some for each core, so a run over many chunks
does not pay Spark's fixed costs for each. A wave's outcomes are stored, below ``outcomes/batch=…``, before the next one starts; what a run that
is killed loses is one wave. A chunk that was stopped is taken up again without the papers that are done. Counters come from metrics
observed for each chunk while the outcomes are written. Only the folders of the batch at hand are listed, however many chunks lie behind it.

A wave in which a task stopped calling ends the run. The next run tries the first chunk that was left open with a single failure per task, and
goes on as usual once it gets through.
"""

from __future__ import annotations

import dataclasses

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from topicflow.functions.text import strip_reasoning
from topicflow.operators.calls import DONE, FAILED, SKIPPED, CallPolicy, call_model
from topicflow.operators.enrich import pending_summaries
from topicflow.operators.models import ModelFactory

LANDED = "paper_id STRING, abstract STRING, arrival LONG"
OUTCOMES = "paper_id STRING, summary STRING, error STRING, kind STRING, attempts INT, status STRING, chunk LONG, attempt INT"
COUNTERS = "chunk LONG, attempt INT, processed LONG, errors LONG, skipped LONG, calls LONG"
#: Chunks of a wave for each core at most, and of a wave in all (each adds four observed metrics).
CHUNKS_PER_CORE, MAX_WAVE = 8, 128
#: Chunk numbers of a batch begin at its own number times this.
STRIDE = 1_000_000


class ModelIsAway(RuntimeError):
    """A task of the chunk stopped calling; the chunk is taken up again by the next run."""


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*(c.split()[0] for c in schema.split(", ")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every outcome of every attempt."""
    return _stored(spark, f"{folder}/outcomes", OUTCOMES)


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """``paper_id, summary`` of the papers that are done."""
    return read_outcomes(spark, folder).where(F.col("status") == DONE).select("paper_id", "summary")


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """``processed, errors, skipped, calls`` of every attempt at a chunk."""
    return _stored(spark, f"{folder}/counters", COUNTERS)


def land_papers(papers: DataFrame, folder: str, chunk_rows: int) -> None:
    """Write what has arrived of the stream ``papers`` (paper_id, abstract, summary) and is pending, in files of ``chunk_rows`` rows at most.

    Papers landed before are left out. An arrival that is delivered again replaces what it had written.
    """
    spark = papers.sparkSession

    def land(batch: DataFrame, arrival: int) -> None:
        before = _stored(spark, f"{folder}/landed", LANDED).where(F.col("arrival") != arrival)
        pending = pending_summaries(batch.dropDuplicates(["paper_id"]), before.select("paper_id"))
        files = pending.select("paper_id", "abstract").write.mode("overwrite").option("maxRecordsPerFile", chunk_rows)
        files.parquet(f"{folder}/landed/arrival={arrival}")

    stream = papers.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/landing")
    stream.trigger(availableNow=True).start().awaitTermination()


def _last_attempts(spark: SparkSession, folder: str, batch: int) -> tuple[dict[int, int], dict[int, bool]]:
    """Of a batch's chunks the last attempt that left outcomes, and whether it left papers untried; those it has not counted are missing in the second."""
    outcomes = _stored(spark, f"{folder}/outcomes/batch={batch}", OUTCOMES).groupBy("chunk").agg(F.max("attempt").alias("attempt"))
    counters = _stored(spark, f"{folder}/counters/batch={batch}", COUNTERS).groupBy("chunk").agg(F.max(F.struct("attempt", "skipped")).alias("last"))
    attempts = {r["chunk"]: r["attempt"] for r in outcomes.collect()}
    counted = {r["chunk"]: r["last"] for r in counters.collect()}
    for chunk, last in counted.items():
        attempts[chunk] = max(attempts.get(chunk, 0), last["attempt"])
    return attempts, {c: last["skipped"] > 0 for c, last in counted.items() if last["attempt"] == attempts[c]}


def enrich_chunks(papers: DataFrame, folder: str, model: ModelFactory, batch: int, attempts: dict[int, int], policy: CallPolicy) -> None:
    """Summarise those papers (chunk, paper_id, abstract) of a wave that no earlier attempt at the batch has done; raises if a task stopped calling.

    ``attempts`` has the number of this attempt for each chunk of the wave.
    """
    spark = papers.sparkSession
    done = _stored(spark, f"{folder}/outcomes/batch={batch}", OUTCOMES).where(F.col("status") == DONE).select("paper_id")
    left = papers.join(done, "paper_id", "left_anti") if any(attempts.values()) else papers
    answers = call_model(left, model, "paper_id", "abstract", "response", policy, keep=("chunk",))
    summary = F.nullif(strip_reasoning(F.col("response")), F.lit(""))
    status = F.when((F.col("status") == DONE) & summary.isNull(), FAILED).otherwise(F.col("status"))  # an empty answer is none
    attempt = F.element_at(F.create_map(*(x for c, n in attempts.items() for x in (F.lit(c).cast("long"), F.lit(n)))), F.col("chunk"))
    outcomes = answers.select(
        "paper_id", summary.alias("summary"), "error", "kind", "attempts", status.alias("status"), "chunk", attempt.alias("attempt")
    )
    seen, metrics = Observation(), []
    for chunk in attempts:
        own = F.col("chunk") == chunk
        metrics += [F.count_if(own & (F.col("status") == s)).alias(f"{s}_{chunk}") for s in (DONE, FAILED, SKIPPED)]
        metrics.append(F.coalesce(F.sum(F.when(own, F.col("attempts"))), F.lit(0)).alias(f"calls_{chunk}"))
    outcomes.observe(seen, *metrics).write.mode("append").parquet(f"{folder}/outcomes/batch={batch}")
    row = seen.get
    counters = [(c, n, *(row[f"{m}_{c}"] for m in (DONE, FAILED, SKIPPED, "calls"))) for c, n in attempts.items()]
    spark.createDataFrame(counters, COUNTERS).coalesce(1).write.mode("append").parquet(f"{folder}/counters/batch={batch}")
    skipped = {c: row[f"{SKIPPED}_{c}"] for c in attempts if row[f"{SKIPPED}_{c}"]}
    if skipped:
        raise ModelIsAway(f"chunks {sorted(skipped)}: {sum(skipped.values())} papers were not tried after too many failed calls")


def run_chunks(
    spark: SparkSession, folder: str, model: ModelFactory, policy: CallPolicy | None = None, files_per_chunk: int = 1, max_chunks: int | None = None
) -> bool:
    """Work through the landed papers, chunks of ``files_per_chunk`` files in waves; whether the run got to their end.

    A run ends early after ``max_chunks`` chunks, or after a wave in which a task stopped calling; the next one goes on there.
    """
    policy = policy or CallPolicy()
    most = min(CHUNKS_PER_CORE * spark.sparkContext.defaultParallelism, MAX_WAVE)
    taken, size = 0, 1

    def handle(batch: DataFrame, number: int) -> None:
        nonlocal taken, size
        files = sorted(r["file"] for r in batch.select("file").distinct().collect())  # a batch is taken up again with the same files
        chunk_of = {file: number * STRIDE + i // files_per_chunk for i, file in enumerate(files)}
        last, open_ = _last_attempts(spark, folder, number)
        left = [c for c in sorted(set(chunk_of.values())) if open_.get(c, True)]
        while left:
            if taken == max_chunks:
                raise ModelIsAway(f"ended before chunk {left[0]}")
            wave = left[: size if max_chunks is None else min(size, max_chunks - taken)]
            left = left[len(wave) :]
            own = {f: c for f, c in chunk_of.items() if c in set(wave)}
            chunk = F.element_at(F.create_map(*(F.lit(x) for pair in own.items() for x in pair)), F.col("file")).cast("long")
            papers = batch.where(F.col("file").isin(list(own))).select(chunk.alias("chunk"), "paper_id", "abstract")
            was_open = not taken and any(open_.get(c, False) for c in wave)
            careful = dataclasses.replace(policy, max_failures=1) if was_open and policy.max_failures is not None else policy
            taken += len(wave)
            enrich_chunks(papers, folder, model, number, {c: last.get(c, -1) + 1 for c in wave}, careful)
            size = min(2 * size, most)

    stream_of = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_chunk * most).parquet(f"{folder}/landed")
    landed = stream_of.select("paper_id", "abstract", F.col("_metadata.file_path").alias("file"))
    stream = landed.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/chunks")
    query = stream.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if ModelIsAway.__name__ not in str(e):
            raise
        return False
    return True
