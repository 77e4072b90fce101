"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {key: sec}, "sf"}.
Each query is forced with a ``noop`` write (whole result computed, nothing
collected); the time is the median of ``$BENCH_REPEAT`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text", "remove_stopwords", "word_frequency", "top_words", "softmax_scores",
    "model_logits", "lexicon_scores", "scored_table", "sentiment_totals", "modal_sentiment",
    "character_statistics", "describe_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = os.environ.get("BENCH_QUERIES")
    keys = keys.split(",") if keys else HEADLINE

    from tonality.session import get_session
    from tonality.plans.queries import QUERIES

    spark = get_session(f"local[{cpus}]", app="tonality-bench", shuffle_partitions=int(cpus) * 2)
    # the bench tables are single files of one row group: deal them out to the cores
    spark.conf.set("spark.tonality.inputPartitions", str(int(cpus) * 2))
    times = {}
    for k in keys:
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[k] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
