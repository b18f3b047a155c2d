"""Writers for the scan tables and reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import month_of
from ..operators.rollups import rollup_rows
from ..operators.scan import field_rows, scan_rows, violation_rows, with_scan_id
from .seen import FILE_BYTES, read_table, remember

TABLES = ("scans", "field_results", "violations")


def read_scans(spark: SparkSession, path: str, table: str = "scans") -> DataFrame | None:
    """One of the scan tables below ``path``; None if nothing has been written yet."""
    return read_table(spark, f"{path}/{table}")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the Parquet files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def write_by_date(scans: DataFrame, path: str, size: int, file_bytes: int = FILE_BYTES) -> None:
    """Write scans (or rows of scans) in monthly folders, ordered by date, in files of about ``file_bytes`` out of ``size`` bytes.

    Rows are dealt by ranges of (date, hash of the id): a day of many scans is split, days of few share a file.
    Besides these files there is at most one more a month, where a range begins in one month and ends in the next.
    Reports prune on the month, and within files on the statistics of ``scan_date``.
    """
    dated = scans.withColumns({"scan_date": F.to_date("created_at"), "scan_month": month_of(F.col("created_at"))})
    ranges = dated.repartitionByRange(max(1, ceil(size / file_bytes)), "scan_date", F.xxhash64("scan_id"))
    ranges.sortWithinPartitions("scan_month", "scan_date", "scan_id").write.mode("overwrite").partitionBy("scan_month").parquet(path)


def write_scans(scanned: DataFrame, path: str, batch: str, text: str = "text", track_ids: bool = True) -> None:
    """Persist a scanned batch as Parquet tables below ``path``, each in a folder named after the batch.

    The scan runs once, into the nested table; the three flat tables and the daily rollups are derived from what was written and so
    share its times.  Writing a batch again replaces its own rows only.  ``scans`` and ``violations`` are laid
    out by month and date, which trends and pages prune on.  With ``track_ids`` the ids are
    remembered, so that a stream into the same tables leaves them out.
    """
    spark = scanned.sparkSession
    out = scanned if "scan_id" in scanned.columns else with_scan_id(scanned, text)
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    nested = f"{path}/nested_scans/batch={batch}"
    out.write.mode("overwrite").parquet(nested)
    kept = spark.read.schema(out.schema).parquet(nested)
    size = stored_bytes(spark, nested)
    scans = scan_rows(kept, text)
    jobs = [
        lambda: field_rows(kept).write.mode("overwrite").parquet(f"{path}/field_results/batch={batch}"),
        lambda: rollup_rows(scans).write.mode("overwrite").parquet(f"{path}/rollups/batch={batch}"),
        lambda: write_by_date(violation_rows(kept), f"{path}/violations/batch={batch}", size),
        lambda: write_by_date(scans, f"{path}/scans/batch={batch}", size),
    ]
    # the derived tables do not depend on each other; their jobs share the cluster
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()
    if track_ids:
        remember(kept.select("scan_id"), path, batch)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text record per report."""
    reports.select(F.col("report").alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)
