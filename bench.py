"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is timed from construction to a full ``noop`` write (every row
computed, nothing collected).  A small warm-up on sf0.001 runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shapecode.plans.queries import REGISTRY  # noqa: E402
from shapecode.session import get_session  # noqa: E402

HEADLINE = [       # codebook_lloyd trains and stores the dictionary that the later queries load
    "codebook_lloyd", "frame_scores", "codebook_events", "frame_scores_events", "nearest_code", "frames_tumbling", "windows_sliding",
    "labelled_frames", "threshold_sweep", "frame_labels", "stream_detect", "word_totals", "loss_histogram",
]


def run(spark, name, sf_dir):
    t = time.time()
    if name == "codebook_events":      # trains and stores the short signal's dictionary
        from shapecode.config import EVENTS
        from shapecode.plans.queries import stored_codebook
        df = stored_codebook(spark, sf_dir, EVENTS)
    else:
        df = REGISTRY[name][0](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def lloyd_iteration_sec(spark, sf_dir, iters=3):
    """Seconds per all-source Lloyd iteration on a materialised training set."""
    from shapecode.config import LINEITEM
    from shapecode.operators import kmeans as KM
    from shapecode.session import cut_lineage
    from shapecode.sources.tables import signal_samples
    train, budget = KM.training_set(signal_samples(spark, sf_dir, LINEITEM), LINEITEM.w, LINEITEM.step)
    train = cut_lineage(train)
    budget = cut_lineage(budget)
    spent = []
    for n in (1, iters):          # the difference removes the set-up (init, checkpoints)
        t = time.time()
        KM.lloyd(train, budget, LINEITEM.w, max_iter=n)
        spent.append(time.time() - t)
    return (spent[1] - spent[0]) / (iters - 1)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_session()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        run(spark, "frame_scores", warm)
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf_dir), 3)
    extra = {}
    if "frame_scores" in times:
        n = REGISTRY["frame_scores"][0](spark, sf_dir).count()
        extra["frames_scored_per_sec"] = round(n / times["frame_scores"], 1)
    if "nearest_code" in times:
        n = REGISTRY["nearest_code"][0](spark, sf_dir).count()
        extra["windows_assigned_per_sec"] = round(n / times["nearest_code"], 1)
    if "threshold_sweep" in times:
        extra["threshold_sweep_sec"] = times["threshold_sweep"]
    if "codebook_lloyd" in times:
        extra["sec_per_lloyd_iteration"] = round(lloyd_iteration_sec(spark, sf_dir), 3)
    if names == HEADLINE:
        from tools.coder_microbench import vectorized_rate
        extra["frames_per_sec_k1083_w120"] = round(vectorized_rate(spark), 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), **extra}))


if __name__ == "__main__":
    main()
