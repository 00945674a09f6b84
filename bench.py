"""Benchmark: index build + every registered query at one scale factor.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8).  The corpus is rendered from the tables (``corpus_render``) and
indexed once (``index_build``: extract + write snapshot + cache), then each
query runs against
the persisted index and is timed to completion (``count`` of its result, or
a full collect for small results).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeweave import suite  # noqa: E402
from codeweave.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")),
                      app="codeweave-bench")
    times: dict[str, float] = {}
    t = time.perf_counter()
    suite.corpus_for(spark, sf_dir)          # render the corpus (test fixture)
    times["corpus_render"] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    idx = suite.index_for(spark, sf_dir)     # the corpus job: extract + snapshot
    times["index_build"] = round(time.perf_counter() - t, 3)
    for name, fn in suite.QUERIES.items():
        t = time.perf_counter()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    n_files = idx.files.count()
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "index_build_plus_all_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "files": n_files,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
