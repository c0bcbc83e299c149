"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall-clock seconds.

Each query is fully executed with the no-op sink (every row and column is
produced, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from genderlens.plans import queries  # noqa: E402
from genderlens.session import get_spark  # noqa: E402

HEADLINE = [
    "masked_table_names", "dense_id", "random_swap", "stream_masked", "train_conditions",
    "clean_reviews", "masked_table", "term_counts", "mask_neutral", "split_70_30",
    "condition_sets", "augment", "encode_fixed", "vocabulary", "html_fields",
    "binary_metrics", "epoch_metrics", "bias_summary", "rating_kde", "early_stop",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    qs = queries()
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in qs]
    # warm-up: JVM start, class loading and the first parquet footer reads
    qs["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
