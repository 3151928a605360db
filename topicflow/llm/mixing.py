"""Mixing documents to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Rates, none
negative, are then fitted so that the expected tokens of each domain, summed over documents as
``rate * tokens * posterior``, come as near to the targets as they can: least squares by projected gradients. The
gradient moves every rate along its document's posteriors, so after any number of rounds a rate is
``max(0, 1 - posteriors * pull)`` with one ``pull`` per domain. A round is one aggregate over the stored posteriors: the totals, and
their second moments over the documents whose rate is not 0, by which the next step is scaled. Those few
numbers are all that reaches the driver. DataFrame functions throughout.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicflow.llm.common import unused

#: Features are words hashed to so many buckets; evidence is kept where it is this many deviations strong.
BUCKETS, LEAST_Z, LEAST_ROWS = 1 << 18, 4.0, 5
#: Labelled rows the classifier is fitted on, about: those with the smallest hashes.
FIT_ROWS = 20_000
#: Weights of the rates' own squared distance from 1 next to the squared distance from the targets, the last one negligible.
RIDGES = tuple(10.0**-k for k in range(2, 12))
#: A fit has ended where the gradient is so small, or where a smaller ridge brings totals no nearer to the targets than this.
GRADIENT, GAIN = 1e-8, 1e-5
_HALVINGS = 40
#: Share of a posterior's largest possible variance under which a domain is not told apart.
LEAST_VARIANCE = 0.05
_BETWEEN_WORDS = "[ .,;:!?()\"'\\t\\n\\x0b\\f\\r]+"


def words_of(text: str | Column) -> Column:
    """Lower-case words between spaces and punctuation; null and blank texts have none."""
    lower = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(lower, _BETWEEN_WORDS), lambda w: w != "")


def _buckets(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows, one for each domain, as literals."""
    fields = [field.split() for field in schema.split(", ")]
    structs = [F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields))) for row in rows]
    empty = F.array().cast(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in fields)}>>")
    return spark.range(1).select(F.inline(F.array(*structs) if rows else empty))


MODEL = "domain STRING, prior DOUBLE, bucket INT, weight DOUBLE"


def fit_domains(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``domain, prior, bucket, weight`` from ``text, domain``; each domain has one row without bucket, others are its evidence.

    A weight is the log of how much likelier a bucket is in the domain than outside, kept only
    where the counts bear it. Fitted on about ``fit_rows`` rows chosen by a hash of the text; rows
    without a domain are skipped. Without rows there is no domain.
    """
    labelled = labelled.where("domain IS NOT NULL").select("text", "domain")
    n = labelled.count()
    uniform = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(F.coalesce(uniform, F.lit(0.0)) < min(1.0, fit_rows / max(n, 1)))
    features = rows.select("domain", _buckets(words_of("text")).alias("buckets"))
    sizes = {r["domain"]: r["size"] for r in features.groupBy("domain").agg(F.count("*").alias("size")).collect()}
    if not sizes:
        return _rows(labelled.sparkSession, [], MODEL)
    whole = sum(sizes.values())
    counts = features.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket", "domain").agg(F.count("*").alias("k"))
    per_bucket = (
        counts.groupBy("bucket")
        .agg(F.sum("k").alias("all_k"), F.map_from_entries(F.collect_list(F.struct("domain", "k"))).alias("by_domain"))
        .where(F.col("all_k") >= LEAST_ROWS)
    )
    # a bucket meets every domain within its row
    domains = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(n).alias("size")) for d, n in sorted(sizes.items())))
    pairs = per_bucket.select("*", F.inline(domains))
    k = F.coalesce(F.try_element_at("by_domain", F.col("domain")), F.lit(0))
    inside = (k + 0.5) / (F.col("size") + 1.0)
    outside = (F.col("all_k") - k + 0.5) / (whole - F.col("size") + 1.0)
    error = F.sqrt(1.0 / (k + 0.5) + 1.0 / (F.col("all_k") - k + 0.5))
    strong = pairs.select("domain", "bucket", F.log(inside / outside).alias("weight"), error.alias("error"))
    strong = strong.where(F.abs("weight") >= LEAST_Z * F.col("error")).drop("error")
    priors = F.create_map(*(F.lit(x) for d, n in sorted(sizes.items()) for x in (d, float(np.log(n / whole)))))
    bare = _rows(labelled.sparkSession, [(d, float(np.log(n / whole)), None, None) for d, n in sorted(sizes.items())], MODEL)
    return bare.unionByName(strong.select("domain", priors[F.col("domain")].alias("prior"), "bucket", "weight"))


def posteriors(docs: DataFrame, model: DataFrame, priors: Mapping[str, float]) -> DataFrame:
    """One row per distinct ``doc_id`` and text: ``text_key, copies, n_tokens`` and posteriors ``p0, p1, …``.

    Tokens are words. A text without a word gets the priors. Words meet the model in a broadcast
    join (a row per bucket at most, so its size is bounded), and what passes is summed within
    the task, so the shuffle holds one small row per document.
    """
    domains = sorted(priors)
    by_bucket = model.where("bucket IS NOT NULL").groupBy("bucket").agg(
        *(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, d in enumerate(domains))
    )
    # one more bucket stands for the row itself, so that every document passes and copies can be told
    marker = docs.sparkSession.range(1).select(F.lit(BUCKETS).alias("bucket"), *(F.lit(0.0).alias(f"w{i}") for i in range(len(domains))))
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of("text").alias("words"))
    exploded = words.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_tokens"),
        F.explode(F.array_append(_buckets(F.col("words")), F.lit(BUCKETS))).alias("bucket"),
    )
    met = exploded.join(F.broadcast(by_bucket.unionByName(marker)), "bucket")
    copies = F.count_if(F.col("bucket") == BUCKETS).alias("copies")
    sums = met.groupBy("doc_id", "text_key").agg(
        copies, F.max("n_tokens").alias("n_tokens"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(domains)))
    )
    scores = [F.lit(priors[d]) + F.col(f"w{i}") / F.col("copies") for i, d in enumerate(domains)]
    scored = sums.select("doc_id", "text_key", "copies", "n_tokens", *(s.alias(f"s{i}") for i, s in enumerate(scores)))
    names = [f"s{i}" for i in range(len(domains))]
    top = F.greatest(*names) if len(names) > 1 else F.col("s0")
    risen = scored.select("doc_id", "text_key", "copies", "n_tokens", *(F.exp(F.col(n) - top).alias(n) for n in names))
    total = sum((F.col(n) for n in names[1:]), F.col("s0"))
    return risen.select("doc_id", "text_key", "copies", "n_tokens", *((F.col(n) / total).alias(f"p{i}") for i, n in enumerate(names)))


def rate_of(pull: np.ndarray) -> Column:
    """The rate of a document with posteriors ``p0, p1, …``."""
    move = sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(pull)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 - move)


class Fit(NamedTuple):
    """The fitted ``pull`` of each domain, and shares of the corpus's tokens: the ``targets`` used and what was ``reached``."""

    pull: np.ndarray
    targets: np.ndarray
    reached: np.ndarray


def fit_rates(members: DataFrame, weights: list[float]) -> Fit:
    """Nonnegative least squares for ``copies, n_tokens, p0, p1, …`` and target weights, which are taken as shares of all tokens.

    Minimises the squared distance of the domains' totals from the targets, and among the rates that do, the squared distance of rates from 1: a
    small weight on the latter is lowered until totals come no nearer. For each weight the steps of projected gradients, scaled by the moments of the documents
    whose rate is not 0, are shortened until they lower the objective and repeated until the gradient vanishes. Targets
    that cannot be met (a domain without tokens) are met as nearly as least squares can.
    A domain whose posterior hardly varies, because the labels gave no evidence for it, has its natural share as target: rates could
    only reach any other by way of chance. The targets used and the shares reached are returned.
    """
    n = len(weights)
    share = np.array(weights, float)
    if n == 0 or share.sum() <= 0 or (share < 0).any():
        raise ValueError("target weights must not be negative, and some must be positive")
    tokens = float(members.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).first()["n"] or 0)
    upper = [(i, j) for i in range(n) for j in range(i, n)]

    def totals(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the squared rates, the domains' totals and their moments over documents with a positive rate, all a share of the tokens."""
        amount, rate = F.col("n_tokens") * F.col("copies") / F.lit(tokens), F.col("rate")
        own = members.withColumn("rate", rate_of(pull)).withColumn("read", amount * rate).withColumn("open", F.when(rate > 0, amount).otherwise(0.0))
        row = own.agg(
            F.sum(F.col("read") * rate / 2).alias("half"),
            *(F.sum(F.col("read") * F.col(f"p{i}")).alias(f"s{i}") for i in range(n)),
            *(F.sum(F.col("open") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i, j in upper),
        ).first()
        moments = np.zeros((n, n))
        for i, j in upper:
            moments[i, j] = moments[j, i] = row[f"m{i}_{j}"]
        return float(row["half"]), np.array([row[f"s{i}"] for i in range(n)], float), moments

    pull = np.zeros(n)
    if tokens == 0:
        return Fit(pull, np.zeros(n), np.zeros(n))
    half, reached, moments = totals(pull)
    natural = reached
    told = (moments.diagonal() - natural**2) >= LEAST_VARIANCE * natural * (1 - natural)
    if not told.any() or share[told].sum() == 0:
        return Fit(pull, natural, natural)
    targets = np.where(told, share / share[told].sum() * (1 - natural[~told].sum()), natural)
    before = np.inf
    for ridge in RIDGES:
        objective = lambda h, p: h + p @ targets + ridge / 2 * p @ p  # noqa: E731, B023
        while True:
            gradient = reached - targets - ridge * pull
            if np.abs(gradient).max() <= GRADIENT:
                break
            step = np.linalg.solve(moments + ridge * np.eye(n), gradient)
            now, slope = objective(half, pull), gradient @ step
            for halving in range(_HALVINGS):
                tried = pull + step / 2**halving
                found = totals(tried)
                if objective(found[0], tried) <= now - 1e-4 * slope / 2**halving + 1e-15 * abs(now):
                    break
            else:
                break  # no step lowers the objective any more in floating point
            if np.abs(tried - pull).max() <= 1e-13 * (1 + np.abs(pull).max()):
                break
            pull, (half, reached, moments) = tried, found
        distance = float(np.linalg.norm(reached - targets))
        if distance <= GAIN or before - distance <= GAIN:
            break
        before = distance
    return Fit(pull, targets, reached)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], folder: str) -> DataFrame:
    """``docs`` with ``n_tokens``, a posterior per domain (``p_<domain>``) and ``mix_rate``.

    ``labelled`` has text and domain, ``targets`` a weight per domain (a domain that is not named
    weighs 0). Rates say how often a document should be read, 1 being once; their sum over
    tokens matches the targets as nearly as it can; ``fit`` below ``folder`` tells each domain's weight, the target used and the share reached. Null and empty texts have no tokens, the prior as posterior, and the
    rate that follows from it. Repeated rows and ids each get a rate. Empty ``docs`` give no rows;
    an empty ``labelled`` leaves every rate at 1. ``docs`` must not have the names that are added. Model and posteriors
    are written below ``folder``, which all executors share; texts are read whole.
    """
    spark = docs.sparkSession
    fit_domains(labelled).write.parquet(f"{folder}/model")
    model = spark.read.parquet(f"{folder}/model")
    priors = {r["domain"]: r["prior"] for r in model.select("domain", "prior").distinct().collect()}
    domains = sorted(priors)
    if not domains:
        return docs.withColumns({"n_tokens": F.size(words_of("text")).cast("long"), "mix_rate": F.lit(1.0)})
    posteriors(docs, model, priors).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    weights = [float(targets.get(d, 0.0)) for d in domains]
    fit = fit_rates(members.drop("doc_id", "text_key"), weights)
    told = [(d, w, float(t), float(r)) for d, w, t, r in zip(domains, weights, fit.targets, fit.reached)]
    _rows(spark, told, "domain STRING, weight DOUBLE, target DOUBLE, reached DOUBLE").write.parquet(f"{folder}/fit")
    own_id, own_key = unused("own_id", docs.columns), unused("own_key", docs.columns)
    rated = members.select(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), "n_tokens",
        *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), rate_of(fit.pull).alias("mix_rate"),
    )
    same = docs["doc_id"].eqNullSafe(rated[own_id]) & (F.xxhash64(docs["text"]) == rated[own_key])
    return docs.join(rated, same).drop(own_id, own_key)
