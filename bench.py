"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR chooses the data, BENCH_CPUS the local cores, BENCH_QUERIES a comma list of names.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textdist.registry import QUERIES  # noqa: E402
from textdist.session import local_session  # noqa: E402

HEADLINE = [
    "reference_text", "min_words_filter", "seeded_sample", "in_context_examples", "in_context_prompt", "collate_left",
    "encode_vocabulary", "entity_facts", "latest_run",
    "distinct_n", "distinct_n_by_source", "leave_one_out_matches", "self_bleu", "diversity_scorer", "diversity_by_run",
    "knn_radius", "prdc", "prdc_call_with_pca", "assign_to_centroids", "kmeans_buckets",
    "divergence_curve", "pr_curve", "divergence_metrics_by_source", "mauve_call", "multi_scorer",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(app="bench")
    # Start the Python workers and load classes before the clock runs.
    for name in ("featurize_callable", "histogram"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
