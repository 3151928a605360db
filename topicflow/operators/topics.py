"""Key topics of a set of texts: TF-IDF over words and word pairs, or a user-supplied model.

The vocabulary is the most frequent words and pairs. A pair occurs at most as often as
either of its words, so only pairs of words that are themselves frequent enough can get
in. Words are therefore counted first; pairs are then formed from the frequent words
only, which bounds what the second count shuffles, however large the corpus. Both counts
list the terms of a text followed by its distinct terms, so that occurrences and
containing texts come out of one aggregation with map-side combining, keyed by term.

With the vocabulary known, every text becomes a sparse, weighted, normalised vector
within its row, and the vectors are summed: no shuffle by document anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from math import log

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from topicflow.functions.prompts import TOPIC_TEMPLATE
from topicflow.functions.text import STOP_WORDS, neighbours, only_words, tokens, topic_lines
from topicflow.operators.models import ModelFactory, complete
from topicflow.session import shared_dir

MAX_FEATURES = 1000
MIN_DOCUMENTS = 2
CHUNK_CHARS, CHUNKS_PER_BUCKET = 4000, 64
FREQUENT_WORDS = 5000
"""Up to this many words are fetched to prune pairs; with more ties at the cut, nothing is pruned."""

TOPIC_SCHEMA = "rank INT, topic STRING, score DOUBLE"
TERM_SCHEMA = "term STRING, occurrences BIGINT, documents BIGINT"


@dataclass(frozen=True)
class Vocabulary:
    """Kept terms with their occurrences and containing texts, and the words they are made of."""

    terms: tuple[tuple[str, int, int], ...]
    words: frozenset[str]

    def idf(self, texts: int) -> list[float]:
        return [log((1 + texts) / (1 + documents)) + 1 for _, _, documents in self.terms]


def _counts(lists: DataFrame, column: str) -> DataFrame:
    """Occurrences and containing texts of every entry of an array column."""
    listed = lists.select(
        F.size(column).alias("n"), F.posexplode(F.concat(column, F.array_distinct(column))).alias("pos", "term")
    )
    repeat = F.col("pos") < F.col("n")
    return listed.groupBy("term").agg(F.count_if(repeat).alias("occurrences"), F.count_if(~repeat).alias("documents"))


def _most_frequent(counts: DataFrame, n: int) -> list[tuple[str, int, int]]:
    rows = counts.orderBy(F.desc("occurrences"), "term").limit(n).collect()
    return [(r["term"], r["occurrences"], r["documents"]) for r in rows]


def _words(texts: DataFrame, body: str, stop_words: Sequence[str]) -> DataFrame:
    return texts.select(tokens(F.coalesce(body, F.lit("")), stop_words).alias("words"))


def _stored(words: DataFrame) -> DataFrame:
    """Tokens written once below the shared folder for the passes that follow, none of which cleans or splits a text again."""
    folder = shared_dir(words.sparkSession, "tokens")
    words.write.parquet(folder)
    return words.sparkSession.read.schema(words.schema).parquet(folder)


def _pairs(words: DataFrame, allowed: frozenset[str] | None) -> DataFrame:
    """The frequent words of each text (null elsewhere) and the pairs they form."""
    frequent = F.col("words") if allowed is None else only_words("words", sorted(allowed))
    return words.select(frequent.alias("frequent")).select("frequent", neighbours(F.col("frequent")).alias("pairs"))


def fit_vocabulary(
    texts: DataFrame,
    body: str = "body",
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> Vocabulary:
    """The most frequent words and pairs found in enough texts; ties by term.

    Two jobs run, each returning a number of rows bounded by the vocabulary size.
    """
    return _fitted(_stored(_words(texts, body, stop_words)), max_features, min_documents)


def _fitted(words: DataFrame, max_features: int, min_documents: int) -> Vocabulary:
    fetched = max(FREQUENT_WORDS, max_features)
    common = F.col("documents") >= min_documents
    singles = _most_frequent(_counts(words, "words").where(common), fetched)
    allowed = _allowed(singles, fetched, max_features)
    pairs = _most_frequent(_counts(_pairs(words, allowed), "pairs").where(common), max_features)
    terms = sorted(singles + pairs, key=lambda t: (-t[1], t[0]))[:max_features]
    return Vocabulary(tuple(terms), frozenset(w for t, _, _ in terms for w in t.split(" ")))


def kept_terms(texts: DataFrame, body: str = "body", **options) -> DataFrame:
    """The vocabulary with its counts (term, occurrences, documents)."""
    return texts.sparkSession.createDataFrame(list(fit_vocabulary(texts, body, **options).terms), TERM_SCHEMA)


def word_weights(texts: DataFrame, body: str = "body", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """term, weight: the logarithm of its occurrences in millionths, for every word that at least two texts hold."""
    counts = _counts(_words(texts, body, stop_words), "words").where(F.col("documents") >= MIN_DOCUMENTS)
    return counts.select("term", F.round(F.log1p("occurrences") * 1e6).cast("long").alias("weight"))


def top_terms(
    texts: DataFrame,
    n: int = 10,
    body: str = "body",
    stop_words: Sequence[str] = STOP_WORDS,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """The n terms with the largest summed TF-IDF weight (rank, topic, score); ties by term."""
    words = _stored(_words(texts, body, stop_words))
    vocabulary = _fitted(words, max_features, min_documents)
    if not vocabulary.terms:
        return texts.sparkSession.createDataFrame([], TOPIC_SCHEMA)
    names = [t for t, _, _ in vocabulary.terms]
    pairs = _pairs(words, vocabulary.words)
    grams = pairs.select(F.concat(F.array_compact("frequent"), "pairs").alias("grams"))
    counts = CountVectorizerModel.from_vocabulary(names, inputCol="grams", outputCol="tf")
    idf = Vectors.dense(vocabulary.idf(words.count()))
    weights = ElementwiseProduct(scalingVec=idf, inputCol="tf", outputCol="tfidf")
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="unit")
    vectors = unit.transform(weights.transform(counts.transform(grams)))
    total = vectors.select(Summarizer.sum(F.col("unit")).alias("total"))
    scored = F.zip_with(
        vector_to_array("total"),
        F.split(F.lit("\n".join(names)), "\n"),
        lambda s, t: F.struct((-F.round(s, 6)).alias("order"), t.alias("topic"), s.alias("score")),
    )
    best = F.slice(F.array_sort(scored), 1, n)
    return total.select(F.posexplode(best).alias("pos", "t")).select(
        (F.col("pos") + 1).cast("int").alias("rank"), "t.topic", "t.score"
    )


def _selected(selections: Sequence[Sequence[int]]) -> list[Column]:
    """For each selection of years how often it takes a text: 0, 1, or more if it lists the year again."""
    out = []
    for years in selections:
        weight = F.lit(0)
        for year in sorted(set(years)):
            weight = F.when(F.col("year") == year, F.lit(list(years).count(year))).otherwise(weight)
        out.append(weight.cast("long"))
    return out


def terms_of_selections(
    texts: DataFrame,
    selections: Sequence[Sequence[int]],
    n: Sequence[int],
    body: str = "body",
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> list[list[str]]:
    """The first ``n`` terms of several selections of years, as :func:`top_terms` finds them, in three passes over the tokens in all.

    Words, then pairs, are counted for all selections side by side, and the weighted vectors of all are summed in one
    aggregation, so the number of passes does not depend on that of the selections.
    """
    every, fetched = range(len(selections)), max(FREQUENT_WORDS, max_features)
    wanted = texts.where(F.col("year").isin(sorted({y for years in selections for y in years})))
    weights = [w.alias(f"w{s}") for s, w in enumerate(_selected(selections))]
    stored = _stored(wanted.select("year", tokens(F.coalesce(body, F.lit("")), stop_words).alias("words")))
    words = stored.select(*weights, "words")
    sizes = stored.groupBy("year").count().collect()
    texts_of = [sum(r["count"] * list(years).count(r["year"]) for r in sizes) for years in selections]

    listed = words.select(
        *(f"w{s}" for s in every), F.size("words").alias("size"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("pos", "term")
    )
    repeat = F.col("pos") < F.col("size")
    counts = listed.groupBy("term").agg(
        *(F.sum(F.when(repeat, F.col(f"w{s}")).otherwise(0)).alias(f"occurrences{s}") for s in every),
        *(F.sum(F.when(~repeat, F.col(f"w{s}")).otherwise(0)).alias(f"documents{s}") for s in every),
    ).persist()

    def most_frequent(rows: DataFrame, s: int, limit: int) -> list[tuple[str, int, int]]:
        own = rows.select("term", F.col(f"occurrences{s}").alias("occurrences"), F.col(f"documents{s}").alias("documents"))
        return _most_frequent(own.where(F.col("documents") >= min_documents), limit)

    singles = [most_frequent(counts, s, fetched) for s in every]
    counts.unpersist()
    allowed = [_allowed(found, fetched, max_features) for found in singles]
    frequent = words.select(
        *(f"w{s}" for s in every),
        *((F.col("words") if a is None else only_words("words", sorted(a))).alias(f"f{s}") for s, a in enumerate(allowed)),
    )
    chosen = [F.when(F.col(f"w{s}") > 0, neighbours(F.col(f"f{s}"))).otherwise(F.array().cast("array<string>")) for s in every]
    rows = frequent.select(F.inline(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"w{s}").alias("w"), c.alias("pairs")) for s, c in enumerate(chosen)))))
    listed = rows.select("s", "w", F.size("pairs").alias("size"), F.posexplode(F.concat("pairs", F.array_distinct("pairs"))).alias("pos", "term"))
    pairs = listed.groupBy("s", "term").agg(
        F.sum(F.when(repeat, F.col("w")).otherwise(0)).alias("occurrences"), F.sum(F.when(~repeat, F.col("w")).otherwise(0)).alias("documents")
    ).where(F.col("documents") >= min_documents).persist()
    vocabularies = []
    for s in every:
        found = _most_frequent(pairs.where(F.col("s") == s), max_features)
        terms = sorted(singles[s] + found, key=lambda t: (-t[1], t[0]))[:max_features]
        vocabularies.append(Vocabulary(tuple(terms), frozenset(w for t, _, _ in terms for w in t.split(" "))))
    pairs.unpersist()

    vectors, filled = words, [s for s in every if vocabularies[s].terms]
    if not filled:
        return [[] for _ in every]
    kept = vectors.select(
        *(F.col(f"w{s}").cast("double").alias(f"w{s}") for s in filled),
        *(only_words("words", sorted(vocabularies[s].words)).alias(f"f{s}") for s in filled),
    )
    vectors = kept.select(
        *(f"w{s}" for s in filled), *(F.concat(F.array_compact(f"f{s}"), neighbours(F.col(f"f{s}"))).alias(f"g{s}") for s in filled)
    )
    for s in filled:
        names = [t for t, _, _ in vocabularies[s].terms]
        vectors = CountVectorizerModel.from_vocabulary(names, inputCol=f"g{s}", outputCol=f"tf{s}").transform(vectors)
        idf = Vectors.dense(vocabularies[s].idf(texts_of[s]))
        vectors = ElementwiseProduct(scalingVec=idf, inputCol=f"tf{s}", outputCol=f"weighted{s}").transform(vectors)
        vectors = Normalizer(p=2.0, inputCol=f"weighted{s}", outputCol=f"unit{s}").transform(vectors)
    sums = vectors.select(*(Summarizer.sum(F.col(f"unit{s}"), F.col(f"w{s}")).alias(f"total{s}") for s in filled)).first()
    out: list[list[str]] = [[] for _ in every]
    for s in filled:
        scores = sums[f"total{s}"].toArray()
        scored = sorted((-_rounded(x), t) for x, (t, _, _) in zip(scores, vocabularies[s].terms))
        out[s] = [t for _, t in scored[: n[s]]]
    return out


def _rounded(score: float) -> Decimal:
    """Half up at six decimals, as Spark rounds."""
    return Decimal(repr(float(score))).quantize(Decimal("1e-6"), ROUND_HALF_UP)


def _allowed(singles: list[tuple[str, int, int]], fetched: int, max_features: int) -> frozenset[str] | None:
    """Words whose pairs can get into the vocabulary; None if every word's can."""
    allowed = None
    if len(singles) < fetched:
        allowed = frozenset(t for t, _, _ in singles)
    if len(singles) >= max_features:
        cut = singles[max_features - 1][1]
        if len(singles) < fetched or singles[-1][1] < cut:
            allowed = frozenset(t for t, count, _ in singles if count >= cut)
    return allowed


def topic_prompts(
    texts: DataFrame,
    n_topics: int,
    body: str = "body",
    key: str = "paper_id",
    template: str = TOPIC_TEMPLATE,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Prompts (prompt_id, prompt) that together quote every character of every text.

    Texts are cut into pieces of ``chunk_chars``; pieces are dealt to bounded buckets by a hash of the key and
    packed within a bucket in the order of their keys, so a prompt quotes at most twice as much.
    """
    body_text = F.coalesce(F.col(body), F.lit(""))
    total = texts.agg(F.sum(F.char_length(body_text)).alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(total) // (chunk_chars * CHUNKS_PER_BUCKET)))
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(body_text) - 1, F.lit(0)), F.lit(chunk_chars))
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    pieces = texts.select(
        F.col(key).cast("string").alias("key"), F.pmod(hashed, F.lit(buckets)).alias("bucket"), body_text.alias("text"), F.explode(starts).alias("start")
    ).select("key", "bucket", "start", F.substring("text", F.col("start") + 1, F.lit(chunk_chars)).alias("piece"))
    before = Window.partitionBy("bucket").orderBy("key", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("chunk", F.floor(F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) / chunk_chars))
    ordered = F.array_sort(F.collect_list(F.struct("key", "start", "piece")))
    quoted = F.array_join(F.transform(ordered, lambda r: r["piece"]), "\n")
    asked = template.replace("{n}", str(n_topics))
    return placed.groupBy("bucket", "chunk").agg(quoted.alias("quoted")).select(
        F.concat_ws("-", F.col("bucket").cast("string"), F.col("chunk").cast("string")).alias("prompt_id"),
        F.replace(F.lit(asked), F.lit("{texts}"), F.col("quoted")).alias("prompt"),
    )


def model_topics(texts: DataFrame, n_topics: int, model: ModelFactory, body: str = "body", **options) -> DataFrame:
    """Topics that a model names over all texts (rank, topic, score): by the prompts that name them, ties by name."""
    answers = complete(topic_prompts(texts, n_topics, body, **options), model, id_col="prompt_id", prompt_col="prompt")
    named = answers.select("prompt_id", F.explode(F.array_distinct(topic_lines(F.col("response"), n_topics))).alias("topic"))
    counts = named.groupBy("topic").agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "topic").limit(n_topics)
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "topic", "score")))
    return counts.agg(first.alias("best")).select(F.posexplode("best").alias("pos", "t")).select(
        (F.col("pos") + 1).cast("int").alias("rank"), "t.topic", "t.score"
    )


def extract_topics(
    texts: DataFrame, n_topics: int = 10, model: ModelFactory | None = None, body: str = "body", **options
) -> DataFrame:
    """Ordered topics of the texts. With a model, its answers are used unless all fail or are empty."""
    if model is not None:
        rows = [tuple(r) for r in model_topics(texts, n_topics, model, body).collect()]
        if rows:
            return texts.sparkSession.createDataFrame(rows, TOPIC_SCHEMA)
    return top_terms(texts, n_topics, body, **options)


def topic_list(topics: DataFrame) -> list[str]:
    """Topic names in rank order; the frame holds only as many rows as topics were asked for."""
    return [r["topic"] for r in sorted(topics.select("rank", "topic").collect(), key=lambda r: r["rank"])]


TopicFinder = Callable[[DataFrame, int], list[str]]


def default_finder(texts: DataFrame, n_topics: int) -> list[str]:
    return topic_list(top_terms(texts, n_topics))
