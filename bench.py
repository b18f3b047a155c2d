"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The given tables have one row group each, which one task reads.  They are first copied to
one file per core, the layout of a table that is written by more than one task.

Every query is run to the end (all columns, no output) after one warm-up of the
whole set on the smallest tables, so the figures hold execution, not start-up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from labelwright.plans import all_queries
from labelwright.plans.corpus import TABLES
from labelwright.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
HEADLINE = [
    "cmp_08_scan_labels",
    "agg_01_summary",
    "agg_04_trends",
    "nrm_05_canonical_quantity",
    "geo_02_detect_country",
    "ent_00_attributes",
    "pge_04_table_rows",
    "img_15_srt_04_total_score",
    "ocr_03_scan_passes",
    "fnt_03_verdicts",
    "jn_06_compare_records",
]


def dealt(spark, sf_dir: str) -> str:
    """A copy of the tables with one file per core."""
    out = tempfile.mkdtemp(prefix="labelwright-bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(CPUS).write.parquet(f"{out}/{name}.parquet")
    return out


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    all_queries()[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "labelwright-bench", os.environ.get("BENCH_MEMORY", "16g"))
    if os.path.isdir(WARM_DIR):
        for name in HEADLINE:
            run(spark, name, WARM_DIR)
    start = time.perf_counter()
    at = dealt(spark, SF_DIR)
    dealing = round(time.perf_counter() - start, 3)
    seconds = {name: round(run(spark, name, at), 3) for name in HEADLINE}
    labels = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                "dealing_seconds": dealing,
                "labels_per_second": round(labels / seconds["cmp_08_scan_labels"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
