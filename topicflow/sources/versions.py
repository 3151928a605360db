"""A stored collection in versions: an update rewrites the years it touches, and readers join nothing.

``years/held=<version>/year=<year>`` holds a year as that version left it, ``versions/version=<n>`` says for every year which
of them is current. The list of a version is written last, as one file, so readers see an update whole or not at all; data of an update that was
lost before that is overwritten when it is tried again. Updates carry a name and take effect once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from topicflow.sources.papers import latest_summaries, with_summary_column

LISTS = "update STRING, schema STRING, year INT, held LONG, version LONG"


def _current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The list of a version, the latest if none is given: one row for each year."""
    lists = spark.read.schema(LISTS).parquet(f"{path}/versions")
    if version is None:
        version = lists.agg(F.max("version")).first()[0]
    return lists.where(F.col("version") == version)


def _publish(spark: SparkSession, path: str, version: int, update: str, schema_of_papers: str, held: dict[int, int]) -> None:
    rows = [(update, schema_of_papers, year, at) for year, at in sorted(held.items())] or [(update, schema_of_papers, None, None)]
    schema = LISTS.rpartition(",")[0]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def _write_years(papers: DataFrame, path: str, version: int) -> None:
    papers.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{path}/years/held={version}")


def create_versioned(papers: DataFrame, path: str) -> None:
    """Store a collection (with ``paper_id`` and ``year``, which no row may lack) as version 0."""
    papers = with_summary_column(papers)
    _write_years(papers, path, 0)
    years = [r["year"] for r in papers.select("year").distinct().collect()]
    _publish(papers.sparkSession, path, 0, "", papers.schema.json(), {year: 0 for year in years})


def read_versioned(spark: SparkSession, path: str, version: int | None = None, years: list[int] | None = None) -> DataFrame:
    """The collection as a version has it, the latest if none is given; of some years or all."""
    current = _current(spark, path, version).collect()
    schema = StructType.fromJson(json.loads(current[0]["schema"]))
    paths = [f"{path}/years/held={r['held']}/year={r['year']}" for r in current if r["year"] is not None and (years is None or r["year"] in years)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/years").parquet(*paths).select(*schema.names)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, update`` and how many years each version wrote anew."""
    lists = spark.read.schema(LISTS).parquet(f"{path}/versions")
    return lists.groupBy("version", "update").agg(F.count_if(F.col("held") == F.col("version")).alias("years"))


def fold_summaries(spark: SparkSession, path: str, log: DataFrame, update: str) -> bool:
    """Bring summaries up to date from a part of the log (paper_id, summary, ts); False if ``update`` has been folded before.

    Parts are folded in the order of time. Only years that hold a paper of the log are read whole and written anew.
    """
    lists = spark.read.schema(LISTS).parquet(f"{path}/versions")
    if not lists.where(F.col("update") == update).isEmpty():
        return False
    current = _current(spark, path).collect()
    version, held = current[0]["version"] + 1, {r["year"]: r["held"] for r in current if r["year"] is not None}
    newest = latest_summaries(log).withColumnRenamed("summary", "_new")
    touched = read_versioned(spark, path).select("paper_id", "year").join(newest, "paper_id", "left_semi").select("year").distinct()
    years = [r["year"] for r in touched.collect()]
    if years:
        before = read_versioned(spark, path, years=years)
        after = before.join(newest, "paper_id", "left").withColumn("summary", F.coalesce("_new", "summary")).select(*before.columns)
        _write_years(after, path, version)
    _publish(spark, path, version, update, current[0]["schema"], held | {year: version for year in years})
    return True
