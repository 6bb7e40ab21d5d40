"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints ONE JSON line with per-query seconds and their sum.

Each query is executed in full through the ``noop`` sink (no collect to the driver). The
page parse is timed on its own (``parse_pages``, stored as Parquet) and the stored pages feed the
queries. A query's seconds include building its plan, which are listed apart as well
(``plan``). ``calibration`` is a fixed loop's time on this machine, to compare rounds by."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "internal_links",
    "headings",
    "all_presets_cells",
    "element_counts",
    "nav_items",
    "paragraph_widths",
    "link_page_slice",
    "rt_buttons",
    "part_tables",
    "event_queue",
    "events_routed",
    "tab_sessions",
    "nav_link_inference",
    "page_groups",
    "consent_flow",
    "events_numbered",
]


def main() -> None:
    from gleaner.plans import queries as Q
    from gleaner.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="gleaner-bench")
    # warm-up on the smallest scale (JVM, Python workers), not timed
    Q.pages_dom(spark, "/root/testdata/sf0.001").count()

    times: dict[str, float] = {}
    t = time.time()
    Q.pages_dom(spark, sf_dir)  # parsed and stored
    times["parse_pages"] = round(time.time() - t, 3)
    plans: dict[str, float] = {}
    for name in HEADLINE:
        if name in ("part_tables", "rt_buttons"):  # their pages are stored before the clock starts, as all pages are
            Q.derived_dom(spark, sf_dir, "part" if name == "part_tables" else "customer")
        t = time.time()
        df = Q.QUERIES[name](spark, sf_dir)
        plans[name] = round(time.time() - t, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    t = time.time()
    sum(i * i % 7 for i in range(5_000_000))
    calibration = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "plan": plans, "calibration": calibration}))
    spark.stop()


if __name__ == "__main__":
    main()
