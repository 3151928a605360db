"""Calls to user-supplied models as Spark batch jobs.

A factory is called once per partition and returns a function over a list of inputs,
so a model is loaded once and sees whole Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

BatchFunction = Callable[[Sequence[str]], Sequence]
ModelFactory = Callable[[], BatchFunction]


def call_with_retry(call: BatchFunction, text: str, attempts: int, pause: float) -> tuple[object, str | None, int]:
    """Result, error and number of attempts of one call; a failure never raises."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return call([text])[0], None, attempt
        except Exception as e:  # any model error counts as one failed attempt
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                time.sleep(pause * 2 ** (attempt - 1))
    return None, error, attempts


def call_batch(call: BatchFunction, texts: Sequence[str], attempts: int, pause: float) -> list[tuple[object, str | None, int]]:
    """Results of a batch. A batch that fails is halved until the rows that fail stand alone; only those are tried again."""
    try:
        results = list(call(list(texts)))
        if len(results) != len(texts):
            raise ValueError("the model returned a different number of results")
        return [(r, None, 1) for r in results]
    except Exception:
        if len(texts) <= 1:
            return [call_with_retry(call, text, attempts, pause) for text in texts]
        half = len(texts) // 2
        return call_batch(call, texts[:half], attempts, pause) + call_batch(call, texts[half:], attempts, pause)


def apply_model(
    df: DataFrame,
    factory: ModelFactory,
    id_col: str,
    input_col: str,
    output: str,
    output_type: str = "string",
    attempts: int = 3,
    pause: float = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, output, error, attempts.

    A batch is tried as a whole first and halved where it fails. A row that keeps failing yields a
    null output with the error next to it; the pause between its attempts doubles.
    """

    ids = [id_col, *keep]
    columns = [*ids, output, "error", "attempts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for batch in batches:
            inputs = batch[input_col].tolist()
            results = call_batch(call, inputs, attempts, pause)
            yield pd.DataFrame(
                {
                    **{c: batch[c].tolist() for c in ids},
                    output: [r for r, _, _ in results],
                    "error": [e for _, e, _ in results],
                    "attempts": [a for _, _, a in results],
                },
                columns=columns,
            )

    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids]
    schema = ", ".join([*types, f"`{output}` {output_type}", "error STRING", "attempts INT"])
    return df.select(*ids, input_col).mapInPandas(run, schema)


def complete(df: DataFrame, factory: ModelFactory, id_col: str, prompt_col: str = "prompt", **options) -> DataFrame:
    """Model answers to prompts: id, response, error, attempts."""
    return apply_model(df, factory, id_col, prompt_col, "response", **options)
