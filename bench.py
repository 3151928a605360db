"""Times the headline queries once each after a warm-up and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicflow.plans.queries import QUERIES  # noqa: E402
from topicflow.session import local_session  # noqa: E402

HEADLINES = (
    "topic_trends",
    "papers_per_year",
    "clean_documents",
    "papers_load",
    "merge_decisions",
    "venue_histogram",
    "term_statistics",
    "top_terms_tfidf",
    "emerging_topics",
    "topic_cooccurrence",
    "topic_centrality",
    "knn_exact",
    "knn_year_filtered",
    "knn_cells",
    "embed_hashing",
    "parsed_questions",
    "retrieved_by_question",
    "question_prompts",
    "pending_summaries",
    "applied_summaries",
    "summary_coverage",
    "extractive_summary",
    "trend_report",
)


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    for warm_up in ("summary_coverage", "knn_exact"):
        timed(spark, warm_up, sf_dir)
    seconds = {name: round(timed(spark, name, sf_dir), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
