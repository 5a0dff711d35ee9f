"""Headline queries, warm, as one JSON line.

Each query runs once to warm the code paths at the smallest scale and once
timed at ``BENCH_SF_DIR`` into the no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from hirescope.plans import all_queries
from hirescope.session import local_session

HEADLINE = (
    "A01_latest_sighting", "A03_pooled_bands", "A04_midrank", "A05_assess", "A06_estimate_salary",
    "A09_archive_summary", "H01_collapse", "H02_collapse_reposts", "H03_fold_sightings",
    "H11_work_list", "R05_parse_salary", "R23_score", "T06_requirement_lines", "V01_term_counts",
    "G05_growth_terms", "G08_parse_terms", "G18_guard", "S01_greenhouse", "P01_clean_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cores, "hirescope-bench")
    queries = all_queries()
    warm = str(Path(sf_dir).parent / "sf0.001")
    warm = warm if Path(warm).exists() else sf_dir
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
