"""Every operator as a query over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Array columns are joined into strings and doubles rounded to six decimals, so that the
results can be compared by value with SQL.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicflow.functions.text import strip_reasoning, topic_lines
from topicflow.operators import audit, enrich, ingest, network, topics as topic_ops, trends
from topicflow.operators.answers import (
    answer_prompts,
    answer_questions,
    contexts,
    retrieve_by_question,
    structured_contexts,
)
from topicflow.operators.calls import CallPolicy, call_model
from topicflow.operators.embedding import embed, embeddable
from topicflow.operators.questions import parse_questions
from topicflow.operators.retrieval import (
    fit_cells,
    grouped_matches,
    nearest_papers,
    nearest_papers_in_cells,
    with_cells,
    with_papers,
    write_cells,
)
from topicflow.plans import report as reports
from topicflow.session import shared_dir
from topicflow.sources import driver_tables as src, papers as collection
from topicflow.sources.versions import create_versioned, fold_summaries, read_versioned
from topicflow.sources.arrays import read_json_elements, write_json_arrays
from topicflow.sources.notes import notes_from_json, read_note_lines, write_note_lines
from topicflow.streaming.chunks import land_papers, read_counters, read_outcomes, run_chunks
from topicflow.streaming.enrichment import read_results, start_enrichment

TOPICS = (
    "thanedble", "thintion", "theaeati", "worthless", "pathetic", "disgusting", "tion the", "zzqx",
)
YEARS = (2020, 2024)
RECENT, BEFORE = (2023, 2024), (2020, 2021)
VECTOR_SIZE = 64


def _six(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def _joined(column: str) -> Column:
    return F.array_join(column, "|")


def topic_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = trends.track_topic_trends(src.papers(spark, sf_dir), TOPICS, *YEARS)
    return trend.select("topic", "year", "mentions", "papers_with_topic", "papers", _six("percentage").alias("percentage"))


def topic_trends_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that names topics several times, and an empty one."""
    trend = trends.track_topic_trends(src.papers(spark, sf_dir), [*TOPICS, "", *reversed(TOPICS), TOPICS[0]], *YEARS)
    return trend.select("topic", "year", "mentions", "papers_with_topic", "papers", _six("percentage").alias("percentage"))


#: 500 short needles, by a rule.
MANY_TOPICS = tuple(a + b + c for a in "aeiou" for b in "lmnprstvdc" for c in "aeiounrstl")


def topic_trends_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = trends.track_topic_trends(src.papers(spark, sf_dir), MANY_TOPICS, *YEARS)
    return trend.select("topic", "year", "mentions", "papers_with_topic", "papers")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.papers(spark, sf_dir).select("paper_id", "title", "abstract", "summary")


def flatten_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = ingest.with_required_fields(ingest.flatten_notes(src.raw_notes(spark, sf_dir)))
    return flat.withColumn("authors", _joined("authors")).withColumn("keywords", _joined("keywords"))


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.schema_profile(src.raw_notes(spark, sf_dir))


def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_decisions(src.submissions(spark, sf_dir), src.decision_notes(spark, sf_dir))


def decision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = src.raw_notes(spark, sf_dir)
    decided = notes.select(
        "conference",
        F.try_variant_get("decision", "$", "string").alias("decision"),
        F.col("decision").isNotNull().alias("has_decision"),
    )
    return audit.decision_coverage(decided).withColumn("percentage", _six("percentage"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_fields(ingest.flatten_notes(src.raw_notes(spark, sf_dir)))


def venue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.venue_histogram(ingest.flatten_notes(src.raw_notes(spark, sf_dir)))


def papers_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = ingest.with_required_fields(ingest.flatten_notes(src.raw_notes(spark, sf_dir)))
    accepted, _ = ingest.split_rejects(ingest.to_collection(flat))
    return accepted.withColumn("keywords", _joined("keywords"))


def papers_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.papers_of_year(src.papers(spark, sf_dir, [2023]), 2023).select(
        "paper_id", "title", "abstract", "summary", "year", "venue"
    )


def papers_of_year_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = collection.papers_of_years(src.papers(spark, sf_dir), range(YEARS[0], YEARS[1] + 1), limit_per_year=25)
    return papers.select("paper_id", "year", "title", "venue")


def papers_of_repeated_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.papers_of_years(src.papers(spark, sf_dir, [2023, 2024]), [2023, 2024, 2024]).select("paper_id", "year", "title")


def papers_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.papers_per_year(src.paper_keys(spark, sf_dir), 2019, 2025)


def total_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.paper_keys(spark, sf_dir).agg(F.count("*").alias("total_papers"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_ops.kept_terms(trends.paper_texts(src.papers(spark, sf_dir)))


def top_terms_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = topic_ops.extract_topics(trends.paper_texts(src.papers(spark, sf_dir)), 15)
    return terms.withColumn("score", _six("score"))


def emerging_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.emerging_topics(src.papers(spark, sf_dir, RECENT + BEFORE), RECENT, BEFORE)
    for c in ("recent_frequency", "comparison_frequency", "growth_rate"):
        found = found.withColumn(c, _six(c))
    return found


def chart_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.top_emerging(trends.emerging_topics(src.papers(spark, sf_dir, RECENT + BEFORE), RECENT, BEFORE))
    return found.select("position", "topic", _six("growth_rate").alias("growth_rate"), "status")


def chart_topic_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir)
    keys = topic_ops.default_finder(trends.paper_texts(papers), 15)
    trend = trends.track_topic_trends(papers, keys, *YEARS).where(F.col("rank") <= 5)
    return trend.select("topic", "year", _six("percentage").alias("percentage"))


def topic_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = trends.paper_texts(src.papers(spark, sf_dir))
    return network.document_frequencies(network.pair_counts(texts, TOPICS), TOPICS).select("topic", "papers")


def topic_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.topic_network(src.papers(spark, sf_dir, [YEARS[1]]), YEARS[1]).edges


def topic_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.topic_network(src.papers(spark, sf_dir, [YEARS[1]]), YEARS[1]).nodes


def chart_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = network.topic_network(src.papers(spark, sf_dir, [YEARS[1]]), YEARS[1]).nodes
    return network.most_central(nodes).select("topic", "centrality")


def _mean_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """The mean vector of each group as a query; partial sums of whole vectors are combined on the map side."""
    means = vectors.where(F.col("embedding").isNotNull()).groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("embedding")
    )
    return means.withColumn("query_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def _label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = src.paper_vectors(spark, sf_dir)
    return nearest_papers(vectors, _mean_vectors(vectors, "label"), 5)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_matches(spark, sf_dir).select("query_id", "rank", "paper_id", _six("distance").alias("distance"))


def knn_year_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = src.paper_vectors(spark, sf_dir)
    queries = _mean_vectors(vectors, "label", "year").withColumn("year_exact", F.col("year"))
    return nearest_papers(vectors, queries, 5).select("query_id", "rank", "paper_id", _six("distance").alias("distance"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = src.paper_vectors(spark, sf_dir)
    queries = _mean_vectors(vectors, "label", "year").withColumn("year_exact", F.col("year") + 3)
    matches = nearest_papers(vectors, queries, 5)
    lists = grouped_matches(queries, matches)
    return lists.select("query_id", F.array_join(F.transform("papers", lambda p: p["paper_id"]), "|").alias("papers"))


def knn_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_papers(_label_matches(spark, sf_dir), src.papers(spark, sf_dir), "title", "year").select(
        "query_id", "rank", "title", "year"
    )


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``knn_exact`` over vectors that are written by cell and read back."""
    vectors, stored = src.paper_vectors(spark, sf_dir), shared_dir(spark, "cells")
    centres = fit_cells(vectors, VECTOR_SIZE)
    write_cells(with_cells(vectors, centres), stored)
    matches = nearest_papers_in_cells(spark.read.parquet(stored), _mean_vectors(vectors, "label"), centres, k=5)
    return matches.select("query_id", "rank", "paper_id", _six("distance").alias("distance"))


def knn_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query, in several chunks."""
    vectors = src.paper_vectors(spark, sf_dir)
    queries = vectors.select(F.col("paper_id").alias("query_id"), "embedding")
    matches = nearest_papers(vectors, queries, 3, chunk_queries=128)
    return matches.select("query_id", "rank", "paper_id", _six("distance").alias("distance"))


def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed(embeddable(src.papers(spark, sf_dir, summaries=False)))
    return vectors.select("paper_id", F.posexplode("embedding").alias("bucket", "count")).where(F.col("count") > 0).select(
        "paper_id", "bucket", F.col("count").cast("long").alias("count")
    )


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_questions(src.questions(spark, sf_dir))
    return parsed.withColumn("years", _joined(F.col("years").cast("array<string>")))


def parsed_questions_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_questions(src.questions(spark, sf_dir), mode="reference")
    return parsed.select("question_id", "year_exact", "year_from", "year_to")


def _question_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, papers, and the papers nearest to each question."""
    papers, asked = src.papers(spark, sf_dir, summaries=False), src.questions(spark, sf_dir)
    vectors = embed(embeddable(papers), keep=("year",))
    return asked, papers, retrieve_by_question(asked, vectors)


def retrieved_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, matches = _question_matches(spark, sf_dir)
    return matches.withColumn("distance", _six("distance"))


def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, papers, matches = _question_matches(spark, sf_dir)
    return contexts(matches, papers)


def question_contexts_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, papers, matches = _question_matches(spark, sf_dir)
    grouped = structured_contexts(matches, papers)
    return grouped.select(
        "question",
        "year",
        F.array_join(F.transform("papers", lambda p: F.concat(p["title"], F.lit(": "), p["abstract"])), " | ").alias("papers"),
    )


def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, papers, matches = _question_matches(spark, sf_dir)
    return answer_prompts(asked, contexts(matches, papers))


def _last_characters():
    """A model without chance: it answers with the end of its prompt."""
    return lambda prompts: [p[-60:] for p in prompts]


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir, summaries=False)
    vectors = embed(embeddable(papers), keep=("year",))
    return answer_questions(src.questions(spark, sf_dir), vectors, papers, _last_characters)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.flatten_notes(src.raw_notes(spark, sf_dir))


def stored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notes written as JSON lines and read back."""
    folder = shared_dir(spark, "notes")
    write_note_lines(src.raw_notes(spark, sf_dir), folder)
    flat = ingest.flatten_notes(read_note_lines(spark, folder))
    return flat.withColumn("authors", _joined("authors")).withColumn("keywords", _joined("keywords"))


def array_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notes written as JSON arrays and read back in ranges of 256 KB, whatever the session's ranges are."""
    folder = shared_dir(spark, "arrays")
    notes = src.raw_notes(spark, sf_dir)
    write_json_arrays(notes.select(F.to_json(F.struct("*")).alias("element")), folder)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    elements = read_json_elements(session, folder)
    conference = F.try_variant_get(F.parse_json("element"), "$.conference", "string")
    flat = ingest.flatten_notes(notes_from_json(elements.select(conference.alias("conference"), F.col("element").alias("note"))))
    return flat.withColumn("authors", _joined("authors")).withColumn("keywords", _joined("keywords"))


def stored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned papers written by conference and read back."""
    folder = shared_dir(spark, "clean")
    collection.write_clean(ingest.with_required_fields(_flat(spark, sf_dir)), folder)
    return collection.read_clean(spark, folder).select("conference", "paper_id", "number", "title", "abstract", "venue", "decision")


def stored_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection written by year, read back, and given its late column."""
    folder = shared_dir(spark, "collection")
    accepted, _ = ingest.split_rejects(ingest.to_collection(ingest.with_required_fields(_flat(spark, sf_dir))))
    collection.write_collection(accepted, folder)
    stored = collection.with_summary_column(collection.read_collection(spark, folder))
    return stored.select("paper_id", "title", "conference", "venue", "year", _joined("keywords").alias("keywords"), "summary")


def rejected_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose conference names no year; every tenth document has lost its year here."""
    flat = _flat(spark, sf_dir).withColumn(
        "conference", F.when(F.col("number") % 10 == 3, F.substring_index("conference", "_", 1)).otherwise(F.col("conference"))
    )
    _, rejects = ingest.split_rejects(ingest.to_collection(flat))
    return rejects.select("paper_id", "conference", "year")


def _refusing():
    """A model that fails on every text of odd length."""

    def answer(texts):
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd length")
        return [t[:40] for t in texts]

    return answer


def enrichment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run leaves when the model fails on some texts."""
    pending = enrich.pending_summaries(src.papers(spark, sf_dir), _processed(spark, sf_dir))
    return enrich.summarise(pending, _refusing, attempts=2).select("paper_id", "summary", F.col("error").isNotNull().alias("failed"), "attempts")


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids treated as already processed: the documents labelled toxic."""
    labels = src.table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    return labels.select(F.col("doc_id").cast("string").alias("paper_id"))


def pending_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = enrich.pending_summaries(src.papers(spark, sf_dir), _processed(spark, sf_dir))
    return collection.enrichment_view(pending)


def applied_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir).select("paper_id", "year", "summary")
    return collection.apply_summaries(papers, src.summary_log(spark, sf_dir))


def folded_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log folded into a stored collection in two parts, one of them twice, and read without a join."""
    path, log = shared_dir(spark, "versions"), src.summary_log(spark, sf_dir)
    create_versioned(src.papers(spark, sf_dir).select("paper_id", "year", "summary"), path)
    earlier, later = log.where("ts < 2"), log.where("ts >= 2")
    for update, part in (("earlier", earlier), ("later", later), ("earlier", earlier)):
        fold_summaries(spark, path, part, update)
    return read_versioned(spark, path).select("paper_id", F.col("year").cast("int").alias("year"), "summary")


def summary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary_coverage(src.papers(spark, sf_dir))


def summary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary_samples(src.papers(spark, sf_dir))


def stripped_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = src.model_responses(spark, sf_dir)
    return responses.select("response_id", strip_reasoning(F.col("response")).alias("answer"))


def model_topic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = topic_lines(strip_reasoning(F.col("response")), 10)
    return src.model_responses(spark, sf_dir).select("response_id", F.posexplode(lines).alias("pos", "topic")).select(
        "response_id", (F.col("pos") + 1).alias("rank"), "topic"
    )


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.summary_prompts(enrich.pending_summaries(src.papers(spark, sf_dir), _processed(spark, sf_dir)))


def prompt_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.compare_prompts(src.papers(spark, sf_dir)).withColumn("mean_prompt_chars", _six("mean_prompt_chars"))


def topics_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_ops.topic_prompts(trends.paper_texts(src.papers(spark, sf_dir)), 15)


def _first_words():
    """A model without chance: it answers with the first three words of its prompt."""

    def answer(prompts):
        return ["\n".join(p.replace("\n", " ").split(" ")[:3]) for p in prompts]

    return answer


def model_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_ops.model_topics(trends.paper_texts(src.papers(spark, sf_dir)), 15, _first_words)


def _summariser(papers: DataFrame) -> enrich.ExtractiveSummary:
    """Weights are stored first: their size is known then, and while it is small the words of the texts are not shuffled to meet them."""
    folder = shared_dir(papers.sparkSession, "weights")
    topic_ops.word_weights(trends.paper_texts(papers)).write.parquet(folder)
    return enrich.ExtractiveSummary(papers.sparkSession.read.parquet(folder))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir)
    return enrich.summarise(enrich.pending_summaries(papers), _summariser(papers)).select("paper_id", "summary")


def enrichment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir)
    results = enrich.summarise(enrich.pending_summaries(papers, _processed(spark, sf_dir)), _summariser(papers))
    return enrich.enrichment_counters(results)


def enrichment_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the resumable job over the document files; the second finds nothing to do."""
    results, checkpoint = (shared_dir(spark, name) for name in ("summaries", "enrichment"))
    model = _summariser(src.papers(spark, sf_dir))
    for _ in range(2):
        start_enrichment(src.arriving_papers(spark, sf_dir), results, checkpoint, model).awaitTermination()
    return read_results(spark, results).select("paper_id", "summary")


def _digest(text: str) -> str:
    """An answer that depends on every character."""
    return f"{len(text)} {hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()}"


def _digesting():
    return lambda texts: [_digest(t) for t in texts]


def _digesting_most():
    """A model that fails for good on one length in seven."""

    def answer(texts):
        if any(len(t) % 7 == 3 for t in texts):
            raise ValueError("not this one")
        return [_digest(t) for t in texts]

    return answer


def _away():
    def answer(texts):
        raise ConnectionError("away")

    return answer


def _unreliable():
    """A model that hangs, is away or fails for good, by the length of its input."""

    def answer(texts):
        size = len(texts[0])
        if size % 200 == 7:
            time.sleep(6)
        if size % 10 == 3:
            raise ValueError("not this one")
        if size % 10 == 5:
            raise ConnectionError("away")
        return [_digest(t) for t in texts]

    return answer


def enrichment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks of 150, with a run that ends after three of them and one that goes on."""
    folder = shared_dir(spark, "chunks")
    land_papers(src.arriving_papers(spark, sf_dir), folder, 150)
    for most in (3, None):
        run_chunks(spark, folder, _digesting, CallPolicy(in_flight=8), max_chunks=most)
    return read_outcomes(spark, folder).select("paper_id", "summary", "status", "attempts", "attempt")


def enrichment_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs against a model that is away, the second of which only tries once, and one that gets through."""
    folder = shared_dir(spark, "stopped")
    land_papers(src.arriving_papers(spark, sf_dir), folder, 500)
    for model in (_away, _away, _digesting):
        run_chunks(spark, folder, model, CallPolicy(attempts=1, max_failures=5))
    run = F.when((F.col("chunk") == 0) & (F.col("attempt") < 2), F.col("attempt") + 1).otherwise(3)
    counted = read_counters(spark, folder).groupBy(run.alias("run"))
    return counted.agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"), (F.sum("skipped") > 0).alias("skipped_some"), F.sum("calls").alias("calls"))


def enrichment_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters observed while chunks were written, next to those of the table."""
    folder = shared_dir(spark, "counters")
    land_papers(src.arriving_papers(spark, sf_dir), folder, 400)
    run_chunks(spark, folder, _digesting_most, CallPolicy(in_flight=8, max_failures=None))
    names = ("processed", "errors", "skipped")
    observed = read_counters(spark, folder).agg(*(F.sum(n).alias(n) for n in (*names, "calls")))
    of = lambda status: F.count_if(F.col("status") == status)
    table = read_outcomes(spark, folder).agg(*(of(s).alias(f"table_{n}") for n, s in zip(names, ("done", "failed", "skipped"))))
    both = observed.unionByName(table, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def enrichment_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by kind of error, with a model that hangs on some inputs."""
    pending = enrich.pending_summaries(src.papers(spark, sf_dir), _processed(spark, sf_dir))
    policy = CallPolicy(in_flight=8, deadline=2.0, attempts=3, pauses={"connection": 0.01}, max_failures=None)
    return call_model(pending, _unreliable, "paper_id", "abstract", "summary", policy).select("paper_id", "summary", "status", "kind", "attempts")


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = enrich.run_statistics(src.run_log(spark, sf_dir))
    for c in ("mean_seconds", "mean_chars", "total_seconds", "corpus_hours"):
        stats = stats.withColumn(c, _six(c))
    return stats


def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = reports.report_facts(reports.trend_report(src.papers(spark, sf_dir), *YEARS))
    return facts.withColumn("value", _six("value"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(reports.trend_report(src.papers(spark, sf_dir), *YEARS))


REPORT_FILE = (
    "total_papers LONG, papers_per_year ARRAY<STRUCT<year: INT, papers: LONG>>, key_topics ARRAY<STRUCT<rank: INT, topic: STRING>>, "
    "topic_trends ARRAY<STRUCT<topic: STRING, year: INT, mentions: LONG>>, "
    "emerging_topics ARRAY<STRUCT<topic: STRING, growth_rate: DOUBLE, is_new: BOOLEAN>>, "
    "topics ARRAY<STRUCT<topic: STRING, papers: LONG, centrality: LONG>>, cooccurrence ARRAY<STRUCT<topic1: STRING, topic2: STRING, cooccurrence: LONG>>"
)


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report saved as a JSON file, read back and laid out as facts."""
    folder = shared_dir(spark, "report")
    reports.save_report(reports.trend_report(src.papers(spark, sf_dir), *YEARS), folder)
    saved = spark.read.text(folder, wholetext=True).select(F.from_json("value", REPORT_FILE).alias("r"))

    def facts(section: str, rows: str, item: str, detail: str, value: str) -> F.Column:
        fields = (item, detail, f"round(CAST({value} AS DOUBLE), 6)")
        struct = ", ".join(f"'{n}', {e}" for n, e in zip(("section", "item", "detail", "value"), (f"'{section}'", *fields)))
        return F.expr(f"transform(r.{rows}, x -> named_struct({struct}))")

    every = F.concat(
        facts("papers_per_year", "papers_per_year", "CAST(x.year AS STRING)", "''", "x.papers"),
        facts("key_topics", "key_topics", "x.topic", "''", "x.rank"),
        facts("trend_mentions", "topic_trends", "x.topic", "CAST(x.year AS STRING)", "x.mentions"),
        facts("emerging_growth", "emerging_topics", "x.topic", "if(x.is_new, 'NEW', 'GROWING')", "x.growth_rate"),
        facts("topic_frequency", "topics", "x.topic", "''", "x.papers"),
        facts("centrality", "topics", "x.topic", "''", "x.centrality"),
        facts("cooccurrence", "cooccurrence", "x.topic1", "x.topic2", "x.cooccurrence"),
    )
    return saved.select(F.inline(every))


QUERIES = {
    f.__name__: f
    for f in (
        topic_trends, topic_trends_many, topic_trends_repeated, clean_documents, flatten_notes, schema_profile, merge_decisions, decision_coverage, missing_fields,
        venue_histogram, papers_load, papers_of_year, papers_of_year_limited, papers_of_repeated_years, papers_per_year,
        total_papers, term_statistics, top_terms_tfidf, emerging_topics, chart_emerging, chart_topic_trends,
        topic_document_frequency, topic_cooccurrence, topic_centrality, chart_centrality, knn_exact, knn_year_filtered,
        knn_batch, knn_titles, knn_cells, knn_many_queries, embed_hashing, parsed_questions, parsed_questions_reference, retrieved_by_question,
        question_contexts, question_contexts_by_year, question_prompts, pending_summaries, applied_summaries, folded_summaries,
        summary_coverage, summary_samples, stripped_reasoning, model_topic_lines, rendered_prompts, prompt_comparison,
        topics_prompt, model_topics, extractive_summary, enrichment_counters, enrichment_incremental, run_statistics, trend_report,
        stored_report, enrichment_chunks, enrichment_stopped, enrichment_run_counters, enrichment_deadlines, report_lines, answered_questions, stored_notes, array_notes, stored_papers, stored_collection, rejected_papers, enrichment_failures,
    )
}
