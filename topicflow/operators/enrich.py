"""Summaries for papers: what is pending, prompts, the summarising job, run statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from topicflow.functions.prompts import SUMMARY_TEMPLATE, TEMPLATES, render
from topicflow.functions.text import strip_reasoning, tokens
from topicflow.operators.models import ModelFactory, apply_model, complete

SENTENCE = "[^.!?]+[.!?]*"
CORPUS_PAPERS = 13_223
"""Fixed value: size of the corpus to which run times are extrapolated."""


def pending_summaries(papers: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Papers with an abstract but no summary whose id has not been processed yet."""
    blank = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    pending = papers.where(~blank("abstract") & blank("summary"))
    if processed is None:
        return pending
    return pending.join(processed.select(F.col("paper_id").cast("string")), "paper_id", "left_anti")


def summary_prompts(papers: DataFrame, template: str = SUMMARY_TEMPLATE) -> DataFrame:
    return papers.select("paper_id", render(F.lit(template), F.col("abstract")).alias("prompt"))


def prompt_variants(
    papers: DataFrame, templates: Mapping[str, str] = TEMPLATES, domain: str = "machine learning"
) -> DataFrame:
    """Every template applied to every abstract, expanded within the row."""
    catalog = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()])
    rows = papers.select("paper_id", "abstract", F.inline(catalog))
    return rows.select("paper_id", "template", render(F.col("text"), F.col("abstract"), domain).alias("prompt"))


def compare_prompts(papers: DataFrame, model: ModelFactory | None = None, **options) -> DataFrame:
    """Per template, prompts and their mean length; with a model also answers, failures and answer length."""
    variants = prompt_variants(papers, **options)
    if model is not None:
        variants = variants.withColumn("variant_id", F.concat_ws("\n", "template", "paper_id"))
        answers = complete(variants, model, id_col="variant_id").select(
            F.substring_index("variant_id", "\n", 1).alias("template"), F.length("response").alias("chars"), "error"
        )
        answered = answers.groupBy("template").agg(
            F.count("chars").alias("answers"), F.count("error").alias("failures"), F.avg("chars").alias("mean_answer_chars")
        )
    lengths = variants.groupBy("template").agg(
        F.count("*").alias("prompts"),
        F.sum(F.length("prompt")).alias("prompt_chars"),
        F.avg(F.length("prompt")).alias("mean_prompt_chars"),
    )
    return lengths if model is None else lengths.join(answered, "template")


class ExtractiveSummary:
    """Offline stand-in for a model: the sentences whose words weigh most, in text order.

    ``weights`` (term, weight) is a table, joined by word. A sentence weighs the mean of its words' weights (words as in the
    topic operators, a word without weight counting 0), computed in whole numbers so that
    equal sentences tie exactly; the earlier one then wins.
    """

    def __init__(self, weights: DataFrame, sentences: int = 3):
        self.weights, self.sentences = weights, sentences

    def summaries(self, papers: DataFrame) -> DataFrame:
        """paper_id and summary of every abstract; expressions and joins only."""
        trimmed = F.transform(F.regexp_extract_all(F.coalesce("abstract", F.lit("")), F.lit(SENTENCE), 0), lambda s: F.trim(s))
        split = F.filter(trimmed, lambda s: s != "")
        sentences = papers.select("paper_id", split.alias("sentences"))
        each = sentences.select("paper_id", F.posexplode("sentences").alias("pos", "sentence"))
        words = each.select("paper_id", "pos", F.explode(tokens(F.lower("sentence"))).alias("term"))
        weighed = words.join(self.weights, "term", "left").groupBy("paper_id", "pos").agg(
            F.expr("sum(coalesce(weight, 0)) * 1000 div count(term)").alias("weight")
        )
        scored = weighed.groupBy("paper_id").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "weight"))).alias("weights")
        )
        joined = sentences.join(scored, "paper_id", "left")
        order = F.array_sort(
            F.transform(
                "sentences",
                lambda s, i: F.struct((-F.coalesce(F.try_element_at("weights", i), F.lit(0))).alias("order"), i.alias("pos"), s.alias("sentence")),
            )
        )
        best = F.array_sort(F.transform(F.slice(order, 1, self.sentences), lambda s: F.struct(s["pos"], s["sentence"])))
        return joined.select("paper_id", F.array_join(F.transform(best, lambda s: s["sentence"]), " ").alias("summary"))


def summarise(papers: DataFrame, model: ModelFactory | ExtractiveSummary, **options) -> DataFrame:
    """paper_id, summary, error, attempts for each abstract; reasoning tags are stripped from the answers."""
    if isinstance(model, ExtractiveSummary):
        answers = model.summaries(papers)
        return answers.select(
            "paper_id", F.nullif("summary", F.lit("")).alias("summary"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts")
        )
    answers = apply_model(papers, model, "paper_id", "abstract", "response", **options)
    summary = strip_reasoning(F.col("response"))
    return answers.select("paper_id", F.nullif(summary, F.lit("")).alias("summary"), "error", "attempts")


def summarise_with_prompt(papers: DataFrame, model: ModelFactory, template: str = SUMMARY_TEMPLATE, **options) -> DataFrame:
    """Like :func:`summarise`, for a model that expects the whole prompt."""
    prompts = summary_prompts(papers, template).withColumnRenamed("prompt", "abstract")
    return summarise(prompts, model, **options)


def enrichment_counters(results: DataFrame) -> DataFrame:
    """Processed and failed rows of a run; an empty answer counts as a failure."""
    good = F.length(F.coalesce("summary", F.lit(""))) > 0
    return results.agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("errors"))


def run_statistics(log: DataFrame, corpus_papers: int = CORPUS_PAPERS) -> DataFrame:
    """Mean time and length per run, failed runs included in the mean, and hours for a whole corpus."""
    runs = F.count("*")
    seconds, chars = F.coalesce(F.sum("seconds"), F.lit(0.0)), F.coalesce(F.sum("summary_chars"), F.lit(0))
    return log.agg(
        runs.alias("runs"),
        F.count("error").alias("failed"),
        F.try_divide(seconds, runs).alias("mean_seconds"),
        F.try_divide(chars, runs).alias("mean_chars"),
        seconds.alias("total_seconds"),
        (F.try_divide(seconds, runs) * corpus_papers / 3600).alias("corpus_hours"),
    )
