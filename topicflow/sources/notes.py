"""Raw submission notes: landed JSON files, one folder per conference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicflow.sources.arrays import read_json_elements

NOTE_SCHEMA = "id STRING, forum STRING, number INT, content VARIANT, decision VARIANT"


def conference_from_path(path: str = "_metadata.file_path") -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(F.col(path), "([^/]+)/[^/]+$", 1)


def read_note_arrays(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<conference>/<conference>_notes_with_decisions.json``, each one JSON array.

    The reader streams the array element by element, so no file is ever held as one
    string; still, such a file is one task's. :func:`read_split_note_arrays` reads large ones.
    """
    notes = (
        spark.read.schema(NOTE_SCHEMA).option("multiLine", True).json(f"{root}/*/*_notes_with_decisions.json")
    )
    return notes.select(conference_from_path().alias("conference"), *_columns())


def read_split_note_arrays(spark: SparkSession, root: str) -> DataFrame:
    """The same notes as :func:`read_note_arrays`, each array cut into ranges that several tasks read."""
    elements = read_json_elements(spark, f"{root}/*/*_notes_with_decisions.json")
    return notes_from_json(elements.select(conference_from_path("file").alias("conference"), F.col("element").alias("note")))


def read_note_lines(spark: SparkSession, root: str) -> DataFrame:
    """The splittable layout written by :func:`write_note_lines`."""
    return spark.read.schema(f"{NOTE_SCHEMA}, conference STRING").json(root).select("conference", *_columns())


def write_note_lines(notes: DataFrame, root: str) -> None:
    dealt = notes.hint("rebalance", "conference")
    dealt.write.mode("overwrite").option("ignoreNullFields", True).partitionBy("conference").json(root)


def notes_from_json(df: DataFrame, json_column: str = "note") -> DataFrame:
    """Notes held as JSON text in a column next to their conference."""
    note = F.parse_json(json_column)
    parsed = df.select("conference", note.alias("note"))
    return parsed.select(
        "conference",
        F.try_variant_get("note", "$.id", "string").alias("id"),
        F.try_variant_get("note", "$.forum", "string").alias("forum"),
        F.try_variant_get("note", "$.number", "int").alias("number"),
        F.try_variant_get("note", "$.content", "variant").alias("content"),
        F.try_variant_get("note", "$.decision", "variant").alias("decision"),
    )


def _columns() -> list[str]:
    return ["id", "forum", "number", "content", "decision"]
