"""Resumable enrichment: each paper is summarised once, however often the job runs.

The stream's checkpoint remembers which input files were read. Results go to an
append-only table (paper_id, summary, error, attempts, ts, batch_id); before a batch is
summarised, papers with a successful row are left out, so a batch that is replayed after
a lost driver writes nothing twice. A batch with too many failures is not committed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from topicflow.operators.enrich import pending_summaries, summarise
from topicflow.operators.models import ModelFactory

RESULT_SCHEMA = "paper_id STRING, summary STRING, error STRING, attempts INT, ts TIMESTAMP, batch_id BIGINT"


class TooManyFailures(RuntimeError):
    """The batch had more failures than allowed; its input is read again on the next run."""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result table; empty before the first batch."""
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULT_SCHEMA)


def processed_ids(results: DataFrame) -> DataFrame:
    return results.where(F.length("summary") > 0).select("paper_id").distinct()


def enrich_batch(
    papers: DataFrame, path: str, model: ModelFactory, batch_id: int = -1, max_failure_ratio: float = 0.5, **options
) -> None:
    """Summarise the pending papers of one batch, append the results, then check the failures."""
    spark = papers.sparkSession
    once = papers.dropDuplicates(["paper_id"])
    pending = pending_summaries(once, processed_ids(read_results(spark, path)))
    results = summarise(pending, model, **options)
    stamped = results.withColumn("ts", F.current_timestamp()).withColumn("batch_id", F.lit(batch_id).cast("long"))
    good = F.length(F.coalesce("summary", F.lit(""))) > 0
    stamped.write.mode("append").partitionBy("batch_id").parquet(path)
    if max_failure_ratio < 1.0:
        written = read_results(spark, path).where(F.col("batch_id") == batch_id)
        last = written.groupBy("paper_id").agg(F.max(F.struct("ts", good.alias("good"))).alias("last"))
        ratio = last.agg(F.avg(F.when(F.col("last.good"), 0.0).otherwise(1.0))).first()[0]
        if ratio is not None and ratio > max_failure_ratio:
            raise TooManyFailures(f"{ratio:.0%} of the papers of batch {batch_id} failed")


def start_enrichment(
    papers: DataFrame, path: str, checkpoint: str, model: ModelFactory, max_failure_ratio: float = 0.5, **options
) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        enrich_batch(batch, path, model, batch_id, max_failure_ratio, **options)

    return (
        papers.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_failed(papers: DataFrame, path: str, model: ModelFactory, **options) -> None:
    """Try again the papers whose every attempt failed; the stream will not deliver them anew."""
    results = read_results(papers.sparkSession, path)
    failed = results.select("paper_id").distinct().join(processed_ids(results), "paper_id", "left_anti")
    enrich_batch(papers.join(failed, "paper_id", "left_semi"), path, model, **options)
