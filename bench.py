"""Wall seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from tracequarry import catalog
from tracequarry.session import local

HEADLINE = ("win2_select_by_category", "agg3_grouped_statistics", "slc1_backward_slices", "fus1_fuse", "str3_accumulate_sessions")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(int(os.environ.get("BENCH_CPUS", "8")), "16g")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the engine before the clock
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
